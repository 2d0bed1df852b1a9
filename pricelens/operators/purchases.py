"""Purchases against deals: report cards, observation states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dealsets import pricing_set, signal_set

#: Days in a bucket of the range join; bits of a price within a bucket of prices.
BUCKET, PRICE_BITS = 32, 10
#: The moves that purchases, pins and deals can make.
PURCHASE_MOVES = {"OBSERVING": ("REPORT_PENDING",), "REPORT_PENDING": ("CLOSED",), "CLOSED": ("ARCHIVED",), "ARCHIVED": ("OBSERVING",)}
PIN_MOVES = {"ACTIVE": ("BOUGHT", "MISSED", "DROPPED")}
DEAL_MOVES = {"NEW": ("ACTIVE",), "ACTIVE": ("VERIFIED", "ENDED"), "VERIFIED": ("ENDED",), "ENDED": ("ACTIVE",)}


def report_cards(purchases: DataFrame, deals: DataFrame) -> DataFrame:
    """purchase_id, unobserved, n, cheaper_count, percentile, lowest_opportunity, paid_gap of each purchase; the gap is that to snap_benchmark_price, the benchmark frozen at the purchase, null without one.

    A deal counts from purchased_at for observation_days, both ends included.
    Deals and periods meet by variant and bucket of days, so no pair is made
    that is far apart in time. A period from before the variant's first deal
    is unobserved and has no statistics; a variant without deals is observed
    and has a sample of none.
    """
    day = lambda c: F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))
    bucket = lambda c: F.floor(day(c) / BUCKET)
    end = F.col("purchased_at") + F.make_dt_interval(F.col("observation_days"))
    p = purchases.withColumn("until", end)
    observed = deals.groupBy("variant_id").agg(F.min("first_seen").alias("observed_from"))
    spread = p.withColumn("bucket", F.explode(F.sequence(bucket(F.col("purchased_at")), bucket(F.col("until")))))
    d = pricing_set(deals).select("variant_id", "first_seen", "price_first", "price_min", bucket(F.col("first_seen")).alias("bucket"))
    met = spread.join(d, ["variant_id", "bucket"]).filter((F.col("first_seen") >= F.col("purchased_at")) & (F.col("first_seen") <= F.col("until")))
    got = met.groupBy("purchase_id").agg(F.count("*").alias("n"), F.count_if(F.col("price_first") < F.col("paid_price")).alias("cheaper"), F.min("price_min").alias("lowest"))
    df = p.join(observed, "variant_id", "left").join(got, "purchase_id", "left")
    unobserved = F.coalesce(F.col("purchased_at") < F.col("observed_from"), F.lit(False))
    n = F.when(unobserved, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long")
    frozen = F.col("snap_benchmark_price") if "snap_benchmark_price" in purchases.columns else F.lit(None).cast("long")
    share = F.round(F.try_divide(F.col("cheaper").cast("decimal(18,0)"), F.col("n").cast("decimal(18,0)")), 3).cast("decimal(4,3)")
    return df.select("purchase_id", unobserved.alias("unobserved"), n.alias("n"), F.when(unobserved, 0).otherwise(F.coalesce("cheaper", F.lit(0))).cast("long").alias("cheaper_count"), F.when(~unobserved, share).alias("percentile"), F.when(~unobserved, F.col("lowest")).alias("lowest_opportunity"), (F.col("paid_price") - frozen).alias("paid_gap"))


def expired(purchases: DataFrame, now: Column) -> DataFrame:
    """purchase_id and the state after a tick: OBSERVING past its days becomes REPORT_PENDING."""
    over = now >= F.col("purchased_at") + F.make_dt_interval(F.col("observation_days"))
    return purchases.select("purchase_id", F.when((F.col("state") == "OBSERVING") & over, "REPORT_PENDING").otherwise(F.col("state")).alias("state"))


def count_below(purchases: DataFrame, sample: DataFrame) -> DataFrame:
    """purchase_id, chances: how many sample deals of the variant have a price_min below the price paid; rows only where there are any.

    Prices are counted by variant and bucket first. A purchase takes the whole
    buckets below its own from one array of totals for each variant, and meets
    distinct prices in its own bucket alone. Deals of variants that no purchase
    asks for are left out first, and no array goes through a shuffle by purchase.
    """
    bucket = lambda c: F.shiftright(c, PRICE_BITS)
    sample = sample.join(purchases.select("variant_id"), "variant_id", "left_semi")
    prices = sample.groupBy("variant_id", "price_min").agg(F.count("*").alias("n")).withColumn("bucket", bucket(F.col("price_min")))
    totals = prices.groupBy("variant_id", "bucket").agg(F.sum("n").alias("n")).groupBy("variant_id").agg(F.collect_list(F.struct("bucket", "n")).alias("totals"))
    asked = purchases.select("purchase_id", "variant_id", "paid_price", bucket(F.col("paid_price")).alias("bucket"))
    near = asked.join(prices, ["variant_id", "bucket"]).filter(F.col("price_min") < F.col("paid_price")).groupBy("purchase_id").agg(F.sum("n").alias("near"))
    below = F.aggregate(F.filter("totals", lambda t: t["bucket"] < F.col("bucket")), F.lit(0).cast("long"), lambda acc, t: acc + t["n"])
    df = asked.join(totals, "variant_id").select("purchase_id", below.alias("below")).join(near, "purchase_id", "left")
    return df.select("purchase_id", (F.col("below") + F.coalesce("near", F.lit(0))).alias("chances")).filter("chances > 0")


def issued_cards(purchases: DataFrame, deals: DataFrame, issued: DataFrame, now: Column) -> DataFrame:
    """Report cards of purchases that wait for one, whose observation is over and that have none yet (purchase_id in issued)."""
    over = now >= F.col("purchased_at") + F.make_dt_interval(F.col("observation_days"))
    due = purchases.filter((F.col("state") == "REPORT_PENDING") & over).join(issued.select("purchase_id"), "purchase_id", "left_anti")
    return report_cards(due, deals)


def transitions(moves: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """moves (state, target, ...) with ok: whether a state machine allows the move."""
    ok = F.lit(False)
    for state, targets in allowed.items():
        ok = ok | ((F.col("state") == state) & F.col("target").isin(*targets))
    return moves.withColumn("ok", F.coalesce(ok, F.lit(False)))


def observation_context(purchases: DataFrame, deals: DataFrame, now: Column) -> DataFrame:
    """purchase_id, kind, active_lowest, overpaid_won, overpaid_ratio, day, cheaper_chances of purchases not closed.

    Where a deal is on, the cheapest last price against the price paid; where
    none is, the day of observation (from 1) and how many sample deals were
    ever cheaper, which is counted for these purchases alone.
    """
    on = signal_set(deals).groupBy("variant_id").agg(F.min("price_last").alias("lowest"))
    open_ = purchases.filter(F.col("state") != "CLOSED")
    kind = F.when(F.col("state") == "REPORT_PENDING", "REPORT_PENDING").when(F.col("lowest").isNotNull(), "ACTIVE_DEAL").otherwise("NO_ACTIVE_DEAL")
    stood = open_.join(on, "variant_id", "left")
    df = stood.join(count_below(stood.filter(kind == "NO_ACTIVE_DEAL"), pricing_set(deals)), "purchase_id", "left")
    active = F.when(kind == "ACTIVE_DEAL", F.col("lowest"))
    won, none = F.col("paid_price") - active, kind == "NO_ACTIVE_DEAL"
    return df.select(
        "purchase_id", kind.alias("kind"), active.alias("active_lowest"), won.alias("overpaid_won"),
        F.round(F.try_divide(won.cast("decimal(18,0)"), F.col("paid_price").cast("decimal(18,0)")), 3).cast("decimal(12,3)").alias("overpaid_ratio"),
        F.when(none, F.timestamp_diff("DAY", F.col("purchased_at"), now) + 1).alias("day"), F.when(none, F.coalesce("chances", F.lit(0))).cast("long").alias("cheaper_chances"),
    )
