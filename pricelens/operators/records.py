"""Records and queues: raw posts, refreshed deals, review items, products, rate limits, as-of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.numbers import months_before, percentile_won
from pricelens.functions.rules import allowed_site

from .benchmark import EXPAND_LIMIT, chosen_width, counts_by_width
from .dealsets import occurrence_set, pricing_set

#: Most characters of a title, url and post id, and bytes of a raw record.
LIMITS = (("title", 300), ("url", 2000), ("post_id", 64))
RAW_BYTES = 256 * 1024
#: What a post can be.
STATUSES = ("ACTIVE", "SOLD_OUT", "DELETED")


def oversize(df: DataFrame) -> Column:
    """The first field of a post that is too long; null where none is."""
    own = [F.when(F.length(name) > most, name) for name, most in LIMITS if name in df.columns]
    return F.coalesce(*own, F.when(F.octet_length("raw") > RAW_BYTES, "raw") if "raw" in df.columns else F.lit(None).cast("string"))


def raw_records(posts: DataFrame, arrival: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine): of posts of one site and id the last to arrive; posts with a field too long, and which.

    A status that is none of STATUSES is an error; where posts have
    applied_conditions, derived holds them as JSON.
    """
    if "status" in posts.columns:
        known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce("status", F.lit("null")))).cast("string"))
        posts = posts.withColumn("status", known)
    if "applied_conditions" in posts.columns:
        posts = posts.withColumn("derived", F.to_json(F.struct("applied_conditions")))
    judged = posts.withColumn("violation", oversize(posts))
    others = [c for c in posts.columns if c not in ("site", "post_id")]
    last = F.max_by(F.struct(*others), F.struct(*arrival)).alias("r")
    records = judged.filter("violation IS NULL").groupBy("site", "post_id").agg(last).select("site", "post_id", "r.*")
    return records, judged.filter("violation IS NOT NULL")


def refresh_prices(deals: DataFrame, sources: DataFrame) -> DataFrame:
    """Deals that their linked posts (deal_id, price, captured, status) change: least, greatest and last price, last sighting.

    The last price is that of the latest active post, of equally late ones the
    cheaper; sightings only move on; ended deals stay as they are.
    """
    active = F.col("status") == "ACTIVE"
    got = sources.groupBy("deal_id").agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.max(F.when(active, F.struct("captured", (-F.col("price")).alias("minus")))).alias("latest"), F.max("captured").alias("seen"))
    df = deals.filter(F.col("status") != "ENDED").join(got, "deal_id")
    new = {"price_min": F.least("price_min", "lo"), "price_max": F.greatest("price_max", "hi"), "price_last": F.coalesce(-F.col("latest.minus"), F.col("price_last")), "last_seen": F.greatest("last_seen", "seen")}
    changed = F.lit(False)
    for name, value in new.items():
        changed = changed | ~value.eqNullSafe(F.col(name))
    return df.filter(changed).select("deal_id", *(v.alias(k) for k, v in new.items()))


def preserved_conditions(deals: DataFrame, sources: DataFrame) -> DataFrame:
    """deal_id, conditions of deals (deal_id, conditions) whose posts' conditions (deal_id, conditions), each once and sorted, are some and not what the deal has."""
    got = sources.select("deal_id", F.explode("conditions").alias("c")).groupBy("deal_id").agg(F.array_sort(F.collect_set("c")).alias("new"))
    return deals.join(got, "deal_id").filter(~F.col("new").eqNullSafe(F.col("conditions"))).select("deal_id", F.col("new").alias("conditions"))


def hydrated(deals: DataFrame, sources: DataFrame) -> DataFrame:
    """deals with sites (sorted) and the site and address of the first source by id; sources (deal_id, id, site, url)."""
    got = sources.groupBy("deal_id").agg(F.array_sort(F.collect_set("site")).alias("sites"), F.min_by(F.struct("site", "url"), "id").alias("first"))
    return deals.join(got, "deal_id", "left").withColumn("site", F.col("first.site")).withColumn("source_url", F.col("first.url")).drop("first")


def pinned_increases(deals: DataFrame, refreshed: DataFrame, pins: DataFrame) -> DataFrame:
    """deal_id, was, now of deals with an active pin whose refreshed last price is above the stored one."""
    active = pins.filter(F.col("state") == "ACTIVE").select("deal_id").distinct()
    df = deals.select("deal_id", F.col("price_last").alias("was")).join(refreshed.select("deal_id", F.col("price_last").alias("now")), "deal_id").filter("now > was")
    return df.join(active, "deal_id", "left_semi")


def ingest_tally(posts: DataFrame) -> DataFrame:
    """result, n: what became of posts (site, price, tier): wrong site first, then no price, then the tier of the match."""
    result = F.when(~allowed_site(F.col("site")), "SKIPPED_SITE").when(F.col("price").isNull(), "SKIPPED_NO_PRICE").otherwise(F.col("tier"))
    return posts.groupBy(result.alias("result")).agg(F.count("*").alias("n"))


def ended_deals(deals: DataFrame, sources: DataFrame) -> DataFrame:
    """deal_id, last_seen of deals on whose every linked post is over."""
    over = F.col("status").isin("SOLD_OUT", "DELETED")
    got = sources.groupBy("deal_id").agg(F.bool_and(over).alias("over"), F.max("captured").alias("last_seen")).filter("over")
    return deals.filter(F.col("status") != "ENDED").join(got, "deal_id").select("deal_id", got["last_seen"])


def enqueue(items: DataFrame) -> DataFrame:
    """dedup_key, occurrences, payload (the first), last_seen of review items (dedup_key, payload, at, id)."""
    return items.groupBy("dedup_key").agg(F.count("*").alias("occurrences"), F.min_by("payload", F.struct("at", "id")).alias("payload"), F.max("at").alias("last_seen"))


def prioritized(products: DataFrame, purchases: DataFrame) -> DataFrame:
    """product, waiting, rank of products not archived, in order: those without a purchase and not done first, then by rank, nulls last, then by id."""
    bought = purchases.select("product").distinct().withColumn("bought", F.lit(True))
    df = products.filter(~F.coalesce("archived", F.lit(False))).join(bought, "product", "left")
    waiting = F.col("bought").isNull() & ~F.coalesce("manually_completed", F.lit(False))
    return df.select("product", waiting.alias("waiting"), "rank").orderBy(F.desc("waiting"), F.asc_nulls_last("rank"), "product")


def comparison(listings: DataFrame, axes: DataFrame) -> DataFrame:
    """listing_id, price, values: active listings with their axes' values as a map."""
    values = axes.groupBy("listing_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", "value")))).alias("values"))
    return listings.filter(F.col("status") == "ACTIVE").join(values, "listing_id", "left").select("listing_id", "price", "values")


def used_match(listings: DataFrame, searches: DataFrame) -> DataFrame:
    """listing_id, used_search_id, badge of listings (keyed by search) that hold all required keywords, none excluded and one of each trigger group; badge tells whether a bonus keyword is there."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    df = listings.join(searches, "used_search_id").withColumn("t", plain(F.col("title")))
    has = lambda k: F.col("t").contains(plain(k))
    ok = F.forall("required", has) & ~F.exists("excluded", has) & F.forall("triggers", lambda g: F.exists(g, has))
    return df.filter(ok).select("listing_id", "used_search_id", F.exists("bonus", has).alias("badge"))


def asof_snapshots(purchases: DataFrame, deals: DataFrame, months: int = 6, k: int = 5) -> DataFrame:
    """purchase_id, unobserved, n, m, benchmark_price, tier, sparse_lowest, paid_gap, basis: the benchmark, with its expansion, as it stood at each purchase.

    Purchases and deals meet by variant and year: a purchase looks into its
    own year and the one before, where the widest window begins. Spark's
    estimate knows nothing of the rows that explode adds, so the join is told
    to sort: a broadcast would pass all purchases through the driver. One from
    before the variant's first deal is unobserved and has no figures.
    """
    at = F.col("purchased_at")
    d = pricing_set(deals).select("variant_id", "first_seen", "price_first", "n_sites", F.year("first_seen").alias("year"))
    p = purchases.select("purchase_id", "variant_id", "purchased_at").withColumn("year", F.explode(F.sequence(F.year(months_before(at, EXPAND_LIMIT)), F.year(at))))
    met = p.hint("merge").join(d, ["variant_id", "year"]).filter(F.col("first_seen") <= at)
    met = met.withColumn("age", F.coalesce(*(F.when(F.col("first_seen") >= months_before(at, w), w) for w in range(1, EXPAND_LIMIT + 1)))).filter("age IS NOT NULL")
    width = met.groupBy("purchase_id").agg(counts_by_width().alias("held")).select("purchase_id", chosen_width(F.col("held"), F.lit(months), F.lit(k)).alias("width"))
    got = met.join(width, "purchase_id").filter("age <= width").groupBy("purchase_id").agg(F.count("*").alias("n"), F.count_if(F.col("n_sites") >= 2).alias("m"), percentile_won(F.col("price_first"), 0.5).alias("median"), F.min("price_first").alias("least"))
    since = deals.groupBy("variant_id").agg(F.min("first_seen").alias("since"))
    df = purchases.join(since, "variant_id", "left").join(got, "purchase_id", "left")
    unobserved = F.coalesce(at < F.col("since"), F.lit(False))
    n = F.when(unobserved, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long")
    tier = F.when(~unobserved, F.when(n == 0, "NONE").when(n >= k, "SUFFICIENT").otherwise("SPARSE"))
    price = F.when(tier == "SUFFICIENT", F.col("median"))
    return df.select(
        "purchase_id", unobserved.alias("unobserved"), n.alias("n"), F.when(unobserved, 0).otherwise(F.coalesce("m", F.lit(0))).cast("long").alias("m"), price.alias("benchmark_price"), tier.alias("tier"),
        F.when(tier == "SPARSE", F.col("least")).alias("sparse_lowest"), (F.col("paid_price") - price).alias("paid_gap"), F.lit(f"P={months}mo,K={k}").alias("basis"),
    )


def opportunities(deals: DataFrame, start: Column, end: Column) -> DataFrame:
    """variant_id, in_window, ever, best: a digest's counts and its cheapest chance in [start, end): the last price of a deal on, the least of one over."""
    df = occurrence_set(deals)
    inside = (F.col("first_seen") >= start) & (F.col("first_seen") < end)
    price = F.when(F.col("status") == "ENDED", F.col("price_min")).otherwise(F.col("price_last"))
    return df.groupBy("variant_id").agg(F.count_if(inside).alias("in_window"), F.count("*").alias("ever"), F.min(F.when(inside, price)).alias("best"))
