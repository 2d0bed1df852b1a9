"""Listings that a user asks about: read or looked up, set against the snapshot and a benchmark, with what looks risky."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.numbers import used_percent

from .used import extracted, fallback, risk_signals

#: Percent under the snapshot's lowest from which a price is suspicious. Fixed value: what the snapshot is called.
CHEAP, SOURCE = 30, "활성 매물"


def evaluated(asked: DataFrame, listings: DataFrame, searches: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """request_id, outcome, next, title, price, url, percent, lowest, active, source, risks of each row asked.

    asked: request_id, used_search_id, kind (URL, TEXT, MANUAL), text, title,
    price, url, variant_id (null: no comparison). A URL is looked up among the
    search's listings, the least listing_id of several; TEXT and MANUAL are
    read. What gives nothing is NEEDS_INPUT, with what to ask for next; of an
    unknown search, UNKNOWN_SEARCH. percent is null without a benchmark above
    0; lowest and active tell of the search's active listings. A price that is
    missing among listings isn't the lowest. Repeated requests are rows.
    """
    known = listings.filter(F.col("url").isNotNull()).groupBy("used_search_id", "url").agg(F.min_by(F.struct("title", "price"), "listing_id").alias("polled"))
    active = listings.filter("status = 'ACTIVE'").groupBy("used_search_id").agg(F.min("price").alias("lowest"), F.count("price").alias("active"))
    platforms = searches.select("used_search_id", "platform", "exclude_keywords", F.lit(True).alias("known"))
    df = asked.join(platforms, "used_search_id", "left").join(known, ["used_search_id", "url"], "left").join(active, "used_search_id", "left").join(benchmarks.select("variant_id", "benchmark_price"), "variant_id", "left")
    looked = F.when((F.col("kind") == "URL") & (F.trim("url") != "") & F.col("polled").isNotNull(), F.struct("polled.title", F.col("polled.price").cast("long").alias("price"), "url"))
    df = df.withColumn("x", F.when(F.col("known"), F.coalesce(looked, extracted(F.col("kind"), F.col("text"), F.col("title"), F.col("price"), F.col("url")))))
    got = F.col("x").isNotNull()
    risks = risk_signals(F.col("x.title"), F.coalesce("exclude_keywords", F.array().cast("array<string>")), F.col("x.price"), F.col("lowest"), CHEAP)
    source = F.concat(F.when(F.col("platform") == "BUNJANG", "번개장터").otherwise(F.col("platform")), F.lit(f" {SOURCE}"))
    return df.select(
        "request_id", F.when(F.col("known").isNull(), "UNKNOWN_SEARCH").when(got, "RESOLVED").otherwise("NEEDS_INPUT").alias("outcome"), F.when(F.col("known") & ~got, fallback(F.col("kind"))).alias("next"), "x.title", "x.price", "x.url",
        F.when(got, used_percent(F.col("benchmark_price"), F.col("x.price"))).alias("percent"), F.when(got, F.col("lowest")).alias("lowest"), F.when(got, F.coalesce("active", F.lit(0))).alias("active"), F.when(got, source).alias("source"), F.when(got, risks).alias("risks"),
    )
