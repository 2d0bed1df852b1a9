"""The weekly digest: windows, transitions, pins, what is quiet, and the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dealsets import occurrence_set


def windows(variants: DataFrame, states: DataFrame) -> DataFrame:
    """variant_id, since: from the later of the last digest and the product's beginning; variants (variant_id, created_at), states (variant_id, last_sent_at)."""
    return variants.join(states.select("variant_id", "last_sent_at"), "variant_id", "left").select("variant_id", F.greatest("created_at", "last_sent_at").alias("since"))


def opportunities(deals: DataFrame, windows_: DataFrame, now: Column) -> DataFrame:
    """variant_id, in_window, ever, best of every variant of windows_: occurrences in [since, now) and up to now, and the least price in the window - the last price of a deal that is on, the least of one that is over."""
    price = F.when(F.col("status") == "ENDED", F.col("price_min")).otherwise(F.col("price_last"))
    df = occurrence_set(deals).filter(F.col("first_seen") < now).join(windows_, "variant_id")
    inside = F.col("first_seen") >= F.col("since")
    got = df.groupBy("variant_id").agg(F.count_if(inside).alias("in_window"), F.count("*").alias("ever"), F.min(F.when(inside, price)).alias("best"))
    return windows_.select("variant_id").join(got, "variant_id", "left").select("variant_id", F.coalesce("in_window", F.lit(0)).alias("in_window"), F.coalesce("ever", F.lit(0)).alias("ever"), "best")


def transitions(signals: DataFrame, states: DataFrame, modes: DataFrame) -> DataFrame:
    """variant_id, was, now, reportable: a change of colour counts where the earlier one is known; variants of SPLIT products, which have no single signal, have no transition."""
    df = signals.select("variant_id", "color").join(states.select("variant_id", "stored_color"), "variant_id", "left").join(modes, "variant_id", "left")
    now = F.when(F.coalesce(F.col("demand_axis_mode") == "SPLIT", F.lit(False)), None).otherwise(F.col("color"))
    return df.select("variant_id", F.col("stored_color").alias("was"), now.alias("now"), F.coalesce(F.col("stored_color") != now, F.lit(False)).alias("reportable"))


def pin_events(pins: DataFrame, sent: DataFrame, since: Column, now: Column) -> DataFrame:
    """deal_event_id, event, at: pins bought or missed in [since, now), and revivals of deals that were ever pinned, told in it."""
    inside = lambda c: (c >= since) & (c < now)
    ended = pins.filter(F.col("state").isin("BOUGHT", "MISSED") & inside(F.col("resolved_at"))).select("deal_event_id", F.col("state").alias("event"), F.col("resolved_at").alias("at"))
    back = sent.filter((F.col("kind") == "REOPENED") & inside(F.col("sent_at"))).join(pins.select("deal_event_id").distinct(), "deal_event_id", "left_semi")
    return ended.unionByName(back.select("deal_event_id", F.lit("REVIVED").alias("event"), F.col("sent_at").alias("at")))


def quiet_week(flows: DataFrame, moves: DataFrame) -> DataFrame:
    """quiet: whether no variant had an opportunity (in_window) and none a reportable transition; an empty week is quiet."""
    return flows.select((F.col("in_window") > 0).alias("x")).unionByName(moves.select(F.col("reportable").alias("x"))).agg((~F.coalesce(F.bool_or("x"), F.lit(False))).alias("quiet"))


def lines(flows: DataFrame, moves: DataFrame, names: DataFrame) -> DataFrame:
    """variant_id, line: what the digest says of each variant that has something to say: opportunities and their best price, a change of colour."""
    won = F.format_number(F.col("best"), 0)
    said = F.concat_ws(" · ", F.when(F.col("in_window") > 0, F.concat(F.col("in_window").cast("string"), F.lit("건 (최저 "), won, F.lit("원)"))), F.when(F.col("reportable"), F.concat("was", F.lit(" → "), "now")))
    df = flows.join(moves, "variant_id", "left").join(names, "variant_id").withColumn("said", said).filter("said <> ''")
    return df.select("variant_id", F.concat(F.col("name"), F.lit(": "), F.col("said")).alias("line"))


def summary(flows: DataFrame, told: DataFrame) -> DataFrame:
    """variants, quiet, told: how many variants there are, how many have nothing to say, and how many lines."""
    return flows.agg(F.count("*").alias("variants")).crossJoin(told.agg(F.count("*").alias("told"))).select("variants", (F.col("variants") - F.col("told")).alias("quiet"), "told")


def bookkeeping(states: DataFrame, signals: DataFrame, parts: DataFrame, now: Column) -> DataFrame:
    """variant_id, last_sent_at, stored_color after a send: moved on only if all parts (sent) went out."""
    ok = parts.agg(F.coalesce(F.bool_and("sent"), F.lit(False)).alias("ok"))
    df = states.select("variant_id", "last_sent_at", "stored_color").join(signals.select("variant_id", "color"), "variant_id", "full").crossJoin(F.broadcast(ok))
    return df.select("variant_id", F.when(F.col("ok"), now).otherwise(F.col("last_sent_at")).alias("last_sent_at"), F.when(F.col("ok"), F.coalesce("color", "stored_color")).otherwise(F.col("stored_color")).alias("stored_color"))
