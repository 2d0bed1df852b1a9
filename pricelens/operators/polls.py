"""The log of polls: cursors, drift, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, STREAK, LEAST_RATE = 10, 3, 0.6


def cursors(polls: DataFrame, interval_s: int = 60, base_s: int = 60, cap_s: int = 1800) -> DataFrame:
    """site, last_ok, failures, stopped, next_s: each site's cursor after its log. A block stops a site for good, so later polls don't count; else the wait is the interval after a success and doubles with failures since, up to the cap."""
    key = F.struct("seen_at", "event_id")
    # minima and maxima of a site's log, whatever its length; a row for each site comes back by join
    blocked = polls.filter(F.col("outcome") == "BLOCKED").groupBy("site").agg(F.min(key).alias("blocked"))
    live = polls.join(blocked, "site", "left").filter(F.col("blocked").isNull() | (key <= F.col("blocked")))
    last = live.groupBy("site").agg(F.max(F.when(F.col("outcome") == "OK", key)).alias("ok"), F.bool_or(F.col("outcome") == "BLOCKED").alias("stopped"))
    after = F.col("ok").isNull() | (key > F.col("ok"))
    failures = live.join(last, "site").groupBy("site").agg(F.first("ok.seen_at").alias("last_ok"), F.first("stopped").alias("stopped"), F.count_if((F.col("outcome") == "TRANSIENT") & after).alias("failures"))
    wait = F.when(F.col("failures") == 0, interval_s).otherwise(F.least(F.lit(cap_s), base_s * F.pow(F.lit(2.0), F.col("failures") - 1)))
    return failures.select("site", "last_ok", "failures", "stopped", F.when(~F.col("stopped"), wait.cast("long")).alias("next_s"))


def streak(bad: Column, order) -> Column:
    """Rows since the last that wasn't bad."""
    n = F.row_number().over(order)
    return n - F.coalesce(F.max(F.when(~bad, F.col("n"))).over(order), F.lit(0))


def drift(polls: DataFrame) -> DataFrame:
    """site, event_id, reason of new alerts: no deals or no prices STREAK times running, or a low rate of success in a full window.

    A site alerts once, until a healthy poll; blocked polls are left out. A
    site's log is sorted in one task; drift_stream of streaming.polls keeps four
    numbers a site instead.
    """
    order = Window.partitionBy("site").orderBy("seen_at", "event_id")
    df = polls.filter(F.col("outcome") != "BLOCKED").withColumn("n", F.row_number().over(order))
    ok = F.col("outcome") == "OK"
    last = order.rowsBetween(1 - WINDOW, 0)
    df = df.select(
        "site", "event_id", "seen_at", "n",
        streak(ok & (F.col("deal_count") == 0), order).alias("empty"), streak(ok & (F.col("deal_count") > 0) & (F.col("priced_count") == 0), order).alias("priceless"),
        F.count_if(ok).over(last).alias("good"), (ok & (F.col("deal_count") > 0) & (F.col("priced_count") > 0)).alias("healthy"),
    )
    reason = F.when(F.col("empty") >= STREAK, "EMPTY").when(F.col("priceless") >= STREAK, "PRICELESS").when((F.col("n") >= WINDOW) & (F.col("good") < LEAST_RATE * WINDOW), "UNSTABLE")
    df = df.withColumn("reason", reason)
    # a healthy poll re-arms before its own diagnosis; the first diagnosis since then alerts
    df = df.withColumn("term", F.count_if("healthy").over(order))
    first = Window.partitionBy("site", "term").orderBy("seen_at", "event_id")
    df = df.filter("reason IS NOT NULL").withColumn("k", F.row_number().over(first))
    return df.filter("k = 1").select("site", "event_id", "reason")


def health_alarms(checks: DataFrame, threshold: int = 3) -> DataFrame:
    """component, check_id of the failures (component, check_id, seen_at, ok) that make a streak of just threshold: a longer one alarms once."""
    order = Window.partitionBy("component").orderBy("seen_at", "check_id")
    df = checks.withColumn("run", F.count_if("ok").over(order))
    n = F.row_number().over(Window.partitionBy("component", "run", "ok").orderBy("seen_at", "check_id"))
    return df.withColumn("n", n).filter(~F.col("ok") & (F.col("n") == threshold)).select("component", "check_id")


def health(checks: DataFrame) -> DataFrame:
    """status: UP where every component's last check is, else DOWN; without any component an error."""
    last = checks.groupBy("component").agg(F.max_by("ok", F.struct("seen_at", "check_id")).alias("ok"))
    up = F.when(F.bool_and("ok"), "UP").otherwise("DOWN")
    return last.agg(F.when(F.count("*") == 0, F.raise_error(F.lit("no component")).cast("string")).otherwise(up).alias("status"))


def tick_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, delta of counters (name, value) that a tick changed; one that is missing counts as 0."""
    df = before.select("name", F.col("value").alias("was")).join(after.select("name", F.col("value").alias("is")), "name", "full")
    delta = F.coalesce("is", F.lit(0)) - F.coalesce("was", F.lit(0))
    return df.select("name", delta.alias("delta")).filter("delta <> 0")


def cycle_report(cycles: DataFrame, sites: DataFrame) -> DataFrame:
    """site, deals, no_price, conditional, shipping_unknown, sold_out of every polled site, zeros for those without a deal; cycles holds deals (site, price, conditions, status)."""
    tagged = lambda t: F.array_contains("conditions", t)
    got = cycles.groupBy("site").agg(
        F.count("*").alias("deals"), F.count_if(F.col("price").isNull()).alias("no_price"), F.count_if(F.size("conditions") > 0).alias("conditional"), F.count_if(tagged("배송비미상")).alias("shipping_unknown"), F.count_if(F.col("status") == "SOLD_OUT").alias("sold_out"),
    )
    return sites.select("site").distinct().join(got, "site", "left").select("site", *(F.coalesce(c, F.lit(0)).alias(c) for c in got.columns[1:]))


def cycle_counters(polls: DataFrame) -> DataFrame:
    """site, polls, deals, failures, blocked, priceless."""
    return polls.groupBy("site").agg(F.count("*").alias("polls"), F.sum("deal_count").alias("deals"), F.count_if(F.col("outcome") == "TRANSIENT").alias("failures"), F.count_if(F.col("outcome") == "BLOCKED").alias("blocked"), F.sum(F.col("deal_count") - F.col("priced_count")).alias("priceless"))
