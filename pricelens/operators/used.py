"""Second-hand listings: snapshots, differences, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshots(observations: DataFrame) -> DataFrame:
    """used_search_id, batch, listing_id, price: of several observations in a batch the last wins."""
    return observations.groupBy("used_search_id", "batch", "listing_id").agg(F.max_by("price", "event_id").alias("price"))


def listing_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """listing_id, kind, prev_price, price of what appeared, changed its price or disappeared between two snapshots."""
    a, b = previous.select("listing_id", F.col("price").alias("prev_price"), F.lit(True).alias("was")), current.select("listing_id", "price", F.lit(True).alias("is"))
    df = a.join(b, "listing_id", "full")
    kind = F.when(F.col("was").isNull(), "APPEARED").when(F.col("is").isNull(), "DISAPPEARED").when(~F.col("prev_price").eqNullSafe(F.col("price")), "PRICE_CHANGED")
    return df.select("listing_id", kind.alias("kind"), "prev_price", "price").filter("kind IS NOT NULL")


def batch_diffs(observations: DataFrame) -> DataFrame:
    """used_search_id, batch, listing_id, kind, prev_price, price: what each batch of a search changed against the one before; a search's first batch changes nothing."""
    snaps = snapshots(observations)
    order = Window.partitionBy("used_search_id").orderBy("batch")
    calendar = snaps.select("used_search_id", "batch").distinct().withColumn("before", F.lag("batch").over(order))
    now = snaps.join(calendar.filter("before IS NOT NULL"), ["used_search_id", "batch"])
    later = calendar.filter("before IS NOT NULL").select("used_search_id", F.col("before").alias("was"), F.col("batch").alias("to"))
    old = snaps.withColumnRenamed("batch", "was").join(later, ["used_search_id", "was"]).select("used_search_id", F.col("to").alias("batch"), "listing_id", F.col("price").alias("prev_price"), F.lit(True).alias("old"))
    df = old.join(now.select("used_search_id", "batch", "listing_id", "price", F.lit(True).alias("new")), ["used_search_id", "batch", "listing_id"], "full")
    kind = F.when(F.col("old").isNull(), "APPEARED").when(F.col("new").isNull(), "DISAPPEARED").when(~F.col("prev_price").eqNullSafe(F.col("price")), "PRICE_CHANGED")
    return df.select("used_search_id", "batch", "listing_id", kind.alias("kind"), "prev_price", "price").filter("kind IS NOT NULL")


def new_alerts(matches: DataFrame) -> DataFrame:
    """Rows that alert: candidate, triggers hit, and a price (null never) at most the target, if one is set."""
    return matches.filter(F.col("candidate") & F.col("triggered") & (F.col("target_price").isNull() | F.coalesce(F.col("price") <= F.col("target_price"), F.lit(False))))


def promoted_alerts(events: DataFrame) -> DataFrame:
    """listing_id, kind of listing events (event, promoted, was, price) that tell of a promoted listing: PRICE_DROP where it is cheaper, SOLD_OUT where it is gone."""
    kind = F.when((F.col("event") == "PRICE") & (F.col("price") < F.col("was")), "PRICE_DROP").when(F.col("event") == "SOLD", "SOLD_OUT")
    return events.filter(F.col("promoted")).withColumn("kind", kind).filter("kind IS NOT NULL")


def listing_state(df: DataFrame) -> DataFrame:
    """used_search_id, listing_id, status, price, first_seen, last_seen: each listing after all batches; one that the search's last batch lacks is SOLD, one that came back is ACTIVE."""
    snaps = snapshots(df)
    last = snaps.groupBy("used_search_id").agg(F.max("batch").alias("latest"))
    got = snaps.groupBy("used_search_id", "listing_id").agg(F.max_by("price", "batch").alias("price"), F.min("batch").alias("first_seen"), F.max("batch").alias("last_seen"))
    return got.join(last, "used_search_id").select("used_search_id", "listing_id", F.when(F.col("last_seen") == F.col("latest"), "ACTIVE").otherwise("SOLD").alias("status"), "price", "first_seen", "last_seen")


def unfolded_batches(observations: DataFrame, searches: DataFrame) -> DataFrame:
    """used_search_id, batch: the distinct batches after each search's watermark (listings_folded_through, null for none folded)."""
    df = observations.select("used_search_id", "batch").distinct().join(searches.select("used_search_id", "listings_folded_through"), "used_search_id")
    return df.filter(F.col("listings_folded_through").isNull() | (F.col("batch") > F.col("listings_folded_through"))).select("used_search_id", "batch")


def largest_amount(text: Column) -> Column:
    """The largest sum that a text states in 만 (ten thousands) or 원; numbers without a unit are no sums."""
    every = lambda unit: F.transform(F.regexp_extract_all(text, F.lit(rf"([0-9][0-9,]*)\s*{unit}"), F.lit(1)), lambda n: F.translate(n, ",", "").try_cast("long"))
    return F.array_max(F.concat(F.transform(every("만"), lambda n: n * 10_000), every("원")))


def extracted(kind: Column, text: Column, title: Column, price: Column, url: Column) -> Column:
    """struct(title, price, url) of a listing typed in (MANUAL) or pasted (TEXT: first line, largest amount, first address); null where a part is missing, and for URL, which is looked up."""
    line = F.trim(F.get(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\R"), F.lit(0)))
    amount, link = largest_amount(text), F.regexp_extract(text, r"https?://\S+", 0)
    pasted = F.struct(line.alias("title"), amount.alias("price"), F.when(link != "", link).alias("url"))
    typed = F.struct(F.trim(title).alias("title"), price.cast("long").alias("price"), url.alias("url"))
    return F.when((kind == "MANUAL") & price.isNotNull() & (F.trim(title) != ""), typed).when((kind == "TEXT") & (line != "") & amount.isNotNull(), pasted)


def fallback(kind: Column) -> Column:
    """What to ask for when a kind of input gave nothing."""
    return F.when(kind == "URL", "TEXT").otherwise("MANUAL")


#: The categories of risk.
REPERTOIRE, PRICE_RISK = "업자 레퍼토리 키워드", "가격 이상"


def risk_signals(text: Column, keywords: Column, price: Column, lowest: Column, percent: int) -> Column:
    """Array of (category, detail): each keyword that the text holds, spaces and case aside, and a price that is percent or more below the lowest of the snapshot."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    risk = lambda category, detail: F.struct(F.lit(category).alias("category"), detail.alias("detail"))
    words = F.transform(F.filter(keywords, lambda k: plain(text).contains(plain(k))), lambda k: risk(REPERTOIRE, k))
    cheap = (lowest > 0) & (price <= F.floor(lowest * (100 - percent) / 100))
    return F.concat(F.coalesce(words, F.array().cast("array<struct<category:string,detail:string>>")), F.when(cheap, F.array(risk(PRICE_RISK, F.lit(f"스냅샷 최저 대비 {percent}% 이상 저렴")))).otherwise(F.array().cast("array<struct<category:string,detail:string>>")))


def lifecycle(observations: DataFrame) -> DataFrame:
    """used_search_id, listing_id, batch, event, price: NEW, PRICE, SOLD and REVIVED of every listing.

    A search's batches are numbered; a listing whose next batch isn't the
    search's next was sold at that next batch, and revived when it came again.
    """
    snaps = snapshots(observations)
    calendar = snaps.select("used_search_id", "batch").distinct()
    by_search = Window.partitionBy("used_search_id").orderBy("batch")
    calendar = calendar.withColumn("i", F.row_number().over(by_search)).withColumn("next_batch", F.lead("batch").over(by_search))
    own = Window.partitionBy("used_search_id", "listing_id").orderBy("i")
    df = snaps.join(calendar, ["used_search_id", "batch"]).withColumn("before", F.lag("i").over(own)).withColumn("was", F.lag("price").over(own)).withColumn("after", F.lead("i").over(own))
    gone = F.col("next_batch").isNotNull() & (F.coalesce("after", F.lit(0)) != F.col("i") + 1)
    begin = F.when(F.col("before").isNull(), "NEW").when(F.col("before") != F.col("i") - 1, "REVIVED").when(F.col("was") != F.col("price"), "PRICE")
    event = lambda kind, at: F.struct(at.alias("batch"), kind.alias("event"))
    events = F.array(event(begin, F.col("batch")), event(F.when(gone, "SOLD"), F.col("next_batch")))
    return df.select("used_search_id", "listing_id", "price", F.explode(events).alias("e")).select("used_search_id", "listing_id", "e.batch", "e.event", "price").filter("event IS NOT NULL")
