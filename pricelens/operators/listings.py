"""Second-hand listings folded batch by batch, from where the last fold ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a fold leaves: a row for each listing and one without a listing for each search, all with the batch that the search is folded through.
STATE = "used_search_id long, listing_id long, status string, price long, first_seen date, last_seen date, promoted boolean, folded_through date"


def fold_listings(observations: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, events) after the batches of observations that lie behind each search's folded_through.

    observations: used_search_id, batch, listing_id, price, event_id, alerting
    (whether it would be worth an alert if it were new). events:
    used_search_id, listing_id, batch, event (NEW, REVIVED, PRICE, SOLD), price,
    was (the price before), promoted. A listing that alerted as it was new is
    promoted for good. Of several observations of a listing in a batch the last
    by event_id counts. Only listings that the state holds as ACTIVE stand for
    the time before: no batch is read again. Watermark and listings are rows of
    one table, so neither moves without the other; folding on from a fold is
    folding all at once.
    """
    mark = state.filter("listing_id IS NULL").select("used_search_id", "folded_through")
    seen = observations.join(mark, "used_search_id", "left").filter(F.col("folded_through").isNull() | (F.col("batch") > F.col("folded_through")))
    last = F.max_by(F.struct("price", F.coalesce("alerting", F.lit(False)).alias("alerting")), "event_id")
    snaps = seen.groupBy("used_search_id", "batch", "listing_id").agg(last.alias("x")).select("used_search_id", "batch", "listing_id", "x.price", "x.alerting", F.lit(False).alias("stood"))
    known = state.filter("listing_id IS NOT NULL")
    touched = seen.select("used_search_id").distinct()  # searches without a new batch stay as they are
    stood = known.filter("status = 'ACTIVE'").join(touched, "used_search_id", "left_semi").select("used_search_id", F.col("folded_through").alias("batch"), "listing_id", "price", F.lit(False).alias("alerting"), F.lit(True).alias("stood"))
    every = snaps.unionByName(stood)

    by_search = Window.partitionBy("used_search_id").orderBy("batch")
    calendar = seen.select("used_search_id", "batch").unionByName(mark.join(touched, "used_search_id", "left_semi").select("used_search_id", F.col("folded_through").alias("batch"))).distinct()
    calendar = calendar.withColumn("i", F.row_number().over(by_search)).withColumn("next_batch", F.lead("batch").over(by_search))
    own = Window.partitionBy("used_search_id", "listing_id").orderBy("i")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    old = known.select("used_search_id", "listing_id", F.lit(True).alias("known"), F.col("first_seen").alias("since"), F.col("promoted").alias("was_promoted"))
    df = every.join(calendar, ["used_search_id", "batch"]).join(old, ["used_search_id", "listing_id"], "left")
    df = df.withColumn("before", F.lag("i").over(own)).withColumn("was", F.lag("price").over(own)).withColumn("after", F.lead("i").over(own))
    df = df.withColumn("promoted", F.coalesce("was_promoted", F.first("alerting").over(whole)))
    gone = F.col("next_batch").isNotNull() & (F.coalesce("after", F.lit(0)) != F.col("i") + 1)
    first = F.col("before").isNull()
    begin = F.when(F.col("stood"), None).when(first & F.col("known").isNull(), "NEW").when(first | (F.col("before") != F.col("i") - 1), "REVIVED").when(~F.col("was").eqNullSafe(F.col("price")), "PRICE")
    event = lambda kind, at, was: F.struct(at.alias("batch"), kind.alias("event"), was.alias("was"))
    both = F.array(event(begin, F.col("batch"), F.when(begin == "PRICE", F.col("was"))), event(F.when(gone, "SOLD"), F.col("next_batch"), F.col("price")))
    events = df.select("used_search_id", "listing_id", "price", "promoted", F.explode(both).alias("e")).filter("e.event IS NOT NULL").select("used_search_id", "listing_id", "e.batch", "e.event", "price", "e.was", "promoted")

    through = calendar.groupBy("used_search_id").agg(F.max("batch").alias("through"))
    now = df.groupBy("used_search_id", "listing_id").agg(F.max_by("price", "i").alias("price"), F.min("batch").alias("begun"), F.max("batch").alias("last_seen"), F.first("since").alias("since"), F.first("promoted").alias("promoted")).join(through, "used_search_id")
    now = now.select("used_search_id", "listing_id", F.when(F.col("last_seen") == F.col("through"), "ACTIVE").otherwise("SOLD").alias("status"), "price", F.coalesce("since", "begun").alias("first_seen"), "last_seen", "promoted", F.col("through").alias("folded_through"))
    still = known.join(now.select("used_search_id", "listing_id"), ["used_search_id", "listing_id"], "left_anti").join(through, "used_search_id", "left").withColumn("folded_through", F.coalesce("through", "folded_through")).drop("through")
    heads = mark.join(through, "used_search_id", "full").select("used_search_id", F.coalesce("through", "folded_through").alias("folded_through"))
    for c in ("listing_id", "status", "price", "first_seen", "last_seen", "promoted"):
        heads = heads.withColumn(c, F.lit(None).cast(state.schema[c].dataType))
    return now.unionByName(still).unionByName(heads).select(*state.columns), events
