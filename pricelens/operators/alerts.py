"""Alert decisions of deals against benchmarks, policies and purchases, and what becomes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.numbers import in_quiet_hours

COLD_START = 30  # percent
#: Which alerts stay on in each state of a purchase.
ENABLED = {"OBSERVING": ("JACKPOT", "TARGET", "PAID_PRICE"), "REPORT_PENDING": ("JACKPOT", "TARGET"), "CLOSED": ("JACKPOT", "TARGET", "RELATIVE"), "ARCHIVED": ()}
TRIGGERS = ("JACKPOT", "TARGET", "PAID_PRICE", "RELATIVE")
#: The follow-up that needs no first alert.
UNPROMPTED = "PINNED_PRICE_INCREASED"


def enabled_triggers(purchases: DataFrame) -> DataFrame:
    """variant_id, enabled: the alerts that stay on for a variant with purchases, in the order of TRIGGERS; variants without any have all."""
    on = [F.bool_or(F.col("state").isin(*(s for s, ts in ENABLED.items() if t in ts))).alias(t) for t in TRIGGERS]
    return purchases.groupBy("variant_id").agg(*on).select("variant_id", F.array_compact(F.array(*(F.when(F.col(t), t) for t in TRIGGERS))).alias("enabled"))


def alert_decisions(deals: DataFrame, view: DataFrame, policies: DataFrame, hour: Column, purchases: DataFrame) -> DataFrame:
    """deal_event_id, variant_id, kind (the strongest), also (the rest), labels, outcome (SENT or HELD) of the deals that alert.

    In order of strength: JACKPOT for a cheap outlier, SPECIAL at P25, TARGET
    at the policy's price, GOOD at the median - of a SPARSE sample at its
    lowest case, without a sample well below the current price - and PAID_PRICE
    below what an observed purchase (variant_id, state, paid_price) cost. Where
    a variant's purchases are all archived, JACKPOT and TARGET are off. Ended
    deals never alert; quiet hours hold all alerts but JACKPOT.
    """
    bought = purchases.groupBy("variant_id").agg(F.max(F.when(F.col("state") == "OBSERVING", F.col("paid_price"))).alias("paid"), F.bool_and(F.col("state") == "ARCHIVED").alias("archived"))
    df = deals.filter(F.col("status") != "ENDED").join(view.select("variant_id", "tier", "n", "benchmark_price", "good_deal_line", "lowest_case", "current_price"), "variant_id").join(policies, "variant_id").join(bought, "variant_id", "left")
    price, open_ = F.col("price_first"), ~F.coalesce("archived", F.lit(False))
    good = (price <= F.col("benchmark_price")) | (price <= F.col("lowest_case")) | ((F.col("tier") == "NONE") & (price * 100 <= F.col("current_price") * (100 - COLD_START)))
    kinds = F.array_compact(F.array(
        F.when(open_ & (F.col("outlier_flag") == "LOWER"), "JACKPOT"), F.when(price <= F.col("good_deal_line"), "SPECIAL"), F.when(open_ & (price <= F.col("target_price")), "TARGET"), F.when(good, "GOOD"), F.when(price < F.col("paid"), "PAID_PRICE"),
    ))
    labels = F.array_compact(F.array(
        F.when(F.col("n_sites") >= 2, F.concat(F.col("n_sites").cast("string"), F.lit("개 사이트 검증"))).otherwise("미검증(단독)"),
        F.when(F.col("tier") == "SPARSE", F.concat(F.lit("표본 "), F.col("n").cast("string"), F.lit("건 · 참고용"))).when(F.col("tier") == "NONE", "기준 미확립 · 참고용"),
    ))
    df = df.withColumn("kinds", kinds).filter(F.size("kinds") > 0)
    held = in_quiet_hours(hour, F.col("quiet_start"), F.col("quiet_end")) & (F.col("kinds")[0] != "JACKPOT")
    return df.select("deal_event_id", "variant_id", F.col("kinds")[0].alias("kind"), F.array_join(F.slice("kinds", 2, 4), ",").alias("also"), F.array_join(labels, " · ").alias("labels"), F.when(held, "HELD").otherwise("SENT").alias("outcome"))


def axis_open(value: Column, wanted: Column, mode: Column) -> Column:
    """Whether a deal's demand value may alert: one of wanted where that isn't empty, and known where the product is SPLIT."""
    listed = F.coalesce(F.size(wanted) == 0, F.lit(True)) | F.coalesce(F.array_contains(wanted, value), F.lit(False))
    return listed & ~((mode == "SPLIT") & value.isNull())


def dispatched(deals: DataFrame, decisions: DataFrame, sent: DataFrame, held: DataFrame) -> DataFrame:
    """deal_event_id, outcome (NO_ALERT, SENT, HELD), log_first, hold: what to write for each deal.

    decisions are those of deals whose demand value may alert; sent holds
    (deal_event_id, kind) and held (deal_event_id) of earlier alerts, so a
    first alert is logged once and a held one kept once.
    """
    df = deals.select("deal_event_id").join(decisions.select("deal_event_id", "outcome"), "deal_event_id", "left")
    df = df.join(sent.filter(F.col("kind") == "FIRST").select("deal_event_id").distinct().withColumn("told", F.lit(True)), "deal_event_id", "left")
    df = df.join(held.select("deal_event_id").distinct().withColumn("kept", F.lit(True)), "deal_event_id", "left")
    outcome = F.coalesce("outcome", F.lit("NO_ALERT"))
    return df.select("deal_event_id", outcome.alias("outcome"), ((outcome == "SENT") & F.col("told").isNull()).alias("log_first"), ((outcome == "HELD") & F.col("kept").isNull()).alias("hold"))


def follow_ups(events: DataFrame, sent: DataFrame, deals: DataFrame) -> DataFrame:
    """deal_event_id, kind of the follow-ups (deal_event_id, kind) to send, once each: of deals that still exist and had a first alert - or are pinned and dearer - and no alert of that kind."""
    first = sent.filter(F.col("kind") == "FIRST").select("deal_event_id").distinct().withColumn("told", F.lit(True))
    df = events.select("deal_event_id", "kind").distinct().join(first, "deal_event_id", "left").filter(F.col("told") | (F.col("kind") == UNPROMPTED)).drop("told")
    return df.join(sent.select("deal_event_id", "kind").distinct(), ["deal_event_id", "kind"], "left_anti").join(deals.select("deal_event_id"), "deal_event_id", "left_semi")


def flushed(held: DataFrame, policies: DataFrame, decisions: DataFrame, hour: Column) -> DataFrame:
    """deal_event_id, result of held alerts (deal_event_id, variant_id): WAITING in quiet hours, else SENT where the deal would be sent now, or DROPPED."""
    df = held.join(policies.select("variant_id", "quiet_start", "quiet_end"), "variant_id", "left").join(decisions.select("deal_event_id", "outcome"), "deal_event_id", "left")
    quiet = in_quiet_hours(hour, F.col("quiet_start"), F.col("quiet_end"))
    return df.select("deal_event_id", F.when(quiet, "WAITING").when(F.col("outcome") == "SENT", "SENT").otherwise("DROPPED").alias("result"))
