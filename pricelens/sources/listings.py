"""Second-hand listings from a market's JSON, and what is kept of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.price_text import PAID_UNKNOWN, UNKNOWN_SHIPPING

ITEM = "struct<pid:string,name:string,price:string,status:string,update_time:string,free_shipping:boolean,num_faved:string,ad:boolean,bizseller:boolean>"


def scan_listings(answers: DataFrame) -> DataFrame:
    """page_id, post_id, title, url, headline_price, posted_at (UTC), status, reaction, applied_conditions of the listings in answers (page_id, json).

    Listings without an id or a time are left out; a price that isn't all
    digits is null; shipping that isn't free is paid with the amount unknown.
    An answer that is no JSON has no listings.
    """
    df = answers.select("page_id", F.explode(F.from_json("json", f"struct<list:array<{ITEM}>>")["list"]).alias("x")).filter("x.pid IS NOT NULL AND x.update_time IS NOT NULL")
    price = F.trim("x.price")
    free = F.coalesce("x.free_shipping", F.lit(False))
    tags = F.when(free, F.array().cast("array<string>")).otherwise(F.array(F.lit(PAID_UNKNOWN), F.lit(UNKNOWN_SHIPPING)))
    posted = F.timestamp_seconds(F.col("x.update_time").try_cast("long")).cast("timestamp_ntz")
    return df.select(
        "page_id", F.col("x.pid").alias("post_id"), F.coalesce("x.name", F.lit("")).alias("title"), F.concat(F.lit("https://m.bunjang.co.kr/products/"), "x.pid").alias("url"), F.when(price.rlike("^[0-9]+$"), price.try_cast("long")).alias("headline_price"),
        posted.alias("posted_at"), F.when(F.col("x.status") == "0", "ACTIVE").otherwise("SOLD_OUT").alias("status"), F.coalesce(F.col("x.num_faved").try_cast("long"), F.lit(0)).alias("reaction"), tags.alias("applied_conditions"),
    )


def priced(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings with a price, one row with the number of those dropped for having none); repeats stay."""
    return listings.filter("headline_price IS NOT NULL"), listings.agg(F.count_if(F.col("headline_price").isNull()).alias("dropped"))
