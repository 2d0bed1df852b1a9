"""The review queue, pins on deals, products and comparison axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(items: DataFrame, sources: DataFrame, deals: DataFrame, products: DataFrame) -> DataFrame:
    """The queue as a person sees it: id, type, occurrences, last_seen, url, subject, tags, candidates of pending items, to be ordered by last_seen and id, both descending.

    items (id, type, status, deal_event_id, url, candidate_ids, occurrences,
    last_seen); sources (id, deal_event_id, url), of which a deal's least id
    gives the address; deals (deal_event_id, product_name, label, conditions).
    The address, the subject and the tags of a deal count for items about a
    deal only. Candidates are names in the order of their ids in the item, #id
    where a product is unknown.
    """
    about = F.col("type").isin("OUTLIER_LOWER", "DEMAND_UNKNOWN")
    df = items.filter(F.col("status") == "PENDING").withColumn("deal", F.when(about, F.col("deal_event_id")))
    first = sources.groupBy(F.col("deal_event_id").alias("deal")).agg(F.min_by("url", "id").alias("first_url"))
    named = deals.select(F.col("deal_event_id").alias("deal"), F.concat_ws(" — ", "product_name", "label").alias("subject"), F.array_join(F.array_sort("conditions"), ",").alias("tags"))
    df = df.join(first, "deal", "left").join(named, "deal", "left")
    ids = df.select("id", F.posexplode("candidate_ids").alias("at", "product_id")).join(products.select("product_id", "name"), "product_id", "left")
    names = ids.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("name", F.concat(F.lit("#"), F.col("product_id").cast("string"))).alias("name")))).alias("c"))
    df = df.join(names.select("id", F.transform("c", lambda x: x["name"]).alias("candidates")), "id", "left")
    return df.select("id", "type", "occurrences", "last_seen", F.coalesce("first_url", "url").alias("url"), "subject", F.when(F.col("tags") != "", F.col("tags")).alias("tags"), "candidates")


def resolved(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """id, status, effect of items that decisions (id, verb: promote or reject) meet while they are PENDING; others stay as they are and have no effect.

    Promoting a cheap outlier clears its flag, rejecting it shuts the deal out
    for good; promoting an unknown post teaches its title as an alias.
    """
    df = items.join(decisions.select("id", "verb"), "id", "left")
    open_ = (F.col("status") == "PENDING") & F.col("verb").isin("promote", "reject")
    effect = F.when(F.col("type") == "OUTLIER_LOWER", F.when(F.col("verb") == "promote", "CLEAR_FLAG").otherwise("EXCLUDE")).when((F.col("type") == "UNCLASSIFIED") & (F.col("verb") == "promote"), "LEARN_ALIAS")
    status = F.when(open_ & (F.col("verb") == "promote"), "RESOLVED").when(open_, "DISMISSED").otherwise(F.col("status"))
    return df.select("id", status.alias("status"), F.when(open_, effect).alias("effect"))


def promoted(deals: DataFrame, effects: DataFrame) -> DataFrame:
    """deals after effects (deal_event_id, effect): a promoted deal is no outlier any more; a rejected one keeps its flag and is excluded."""
    df = deals.join(effects.select("deal_event_id", "effect"), "deal_event_id", "left")
    flag = F.when(F.col("effect") == "CLEAR_FLAG", "NONE").otherwise(F.col("outlier_flag"))
    out = F.coalesce(F.col("effect") == "EXCLUDE", F.lit(False)) | F.col("permanently_excluded")
    return df.withColumn("outlier_flag", flag).withColumn("permanently_excluded", out).drop("effect")


def callback(text: Column, chat: Column, allowed: list[int]) -> Column:
    """struct(verb, id) of a button's verb:id from an allowed chat; null for all else."""
    parts = F.split(text, ":")
    number = F.get(parts, F.lit(1)).try_cast("long")
    ok = chat.isin(*allowed) & (F.size(parts) == 2) & F.get(parts, F.lit(0)).isin("promote", "reject") & number.isNotNull()
    return F.when(ok, F.struct(F.get(parts, F.lit(0)).alias("verb"), number.alias("id")))


def shown(items: DataFrame, ids: DataFrame) -> DataFrame:
    """items with one more digest_appearance for those whose id is in ids, however often it is there."""
    marked = ids.select("id").distinct().withColumn("one", F.lit(1))
    df = items.join(marked, "id", "left")
    return df.withColumn("digest_appearances", F.col("digest_appearances") + F.coalesce("one", F.lit(0))).drop("one")


def pinnable(deals: DataFrame) -> DataFrame:
    """Deals that can be pinned: not over, no outlier, not excluded."""
    return deals.filter((F.col("status") != "ENDED") & (F.col("outlier_flag") == "NONE") & ~F.coalesce("permanently_excluded", F.lit(False)))


def pin(requests: DataFrame, deals: DataFrame, pins: DataFrame, sources: DataFrame) -> DataFrame:
    """deal_event_id, anchor_post_id: new pins of requests, once a deal: eligible, with no active pin, anchored at the deal's first source."""
    active = pins.filter(F.col("state") == "ACTIVE").select("deal_event_id")
    df = requests.select("deal_event_id").distinct().join(pinnable(deals).select("deal_event_id"), "deal_event_id", "left_semi").join(active, "deal_event_id", "left_anti")
    return df.join(sources.groupBy("deal_event_id").agg(F.min_by("post_id", "id").alias("anchor_post_id")), "deal_event_id", "left")


def watch_list(pins: DataFrame, deals: DataFrame) -> DataFrame:
    """pin_id, section, missed, revived, price: active pins and resolved ones with their deals; missed tells of an active pin whose deal is over."""
    df = pins.join(deals.select("deal_event_id", "status", "price_last"), "deal_event_id", "left")
    active = F.col("state") == "ACTIVE"
    return df.select("pin_id", F.when(active, "ACTIVE").otherwise("RESOLVED").alias("section"), F.coalesce(active & (F.col("status") == "ENDED"), F.lit(False)).alias("missed"), (active & F.coalesce("revive_unacknowledged", F.lit(False))).alias("revived"), F.col("price_last").alias("price"))


def bought_prefill(pins: DataFrame, deals: DataFrame) -> DataFrame:
    """pin_id, variant_id, price, conditions that a purchase form begins with."""
    return pins.join(deals.select("deal_event_id", "variant_id", "price_last", "conditions"), "deal_event_id", "left").select("pin_id", "variant_id", F.col("price_last").alias("price"), "conditions")


def revived(pins: DataFrame, reopened: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """pin_id, revive_unacknowledged after deals reopened (deal_event_id) and persons took note (pin_id)."""
    back = reopened.select("deal_event_id").distinct().withColumn("back", F.lit(True))
    seen = acknowledged.select("pin_id").distinct().withColumn("seen", F.lit(True))
    df = pins.join(back, "deal_event_id", "left").join(seen, "pin_id", "left")
    flag = ((F.col("state") == "ACTIVE") & F.coalesce("back", F.lit(False))) | F.coalesce("revive_unacknowledged", F.lit(False))
    return df.select("pin_id", (flag & F.col("seen").isNull()).alias("revive_unacknowledged"))


def repeated_ranks(products: DataFrame) -> DataFrame:
    """rank, n of ranks that more than one product has."""
    return products.filter(F.col("rank").isNotNull()).groupBy("rank").agg(F.count("*").alias("n")).filter("n > 1")


def product_summaries(products: DataFrame, axes: DataFrame, variants: DataFrame, archived: bool = False) -> DataFrame:
    """product_id, name, axes, variants (sorted lists, empty for none) of products that are, or aren't, archived."""
    none = F.array().cast("array<string>")
    listed = lambda df, col, name: df.groupBy("product_id").agg(F.array_sort(F.collect_list(col)).alias(name))
    df = products.filter(F.coalesce("archived", F.lit(False)) == archived).join(listed(axes, "name", "axes"), "product_id", "left")
    df = df.join(listed(variants, "label", "variants"), "product_id", "left")
    return df.select("product_id", "name", F.coalesce("axes", none).alias("axes"), F.coalesce("variants", none).alias("variants"))


def missing_axes(wanted: DataFrame, axes: DataFrame) -> DataFrame:
    """product_id, name of axes to add: wanted, once each, and not there."""
    return wanted.select("product_id", "name").distinct().join(axes.select("product_id", "name"), ["product_id", "name"], "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """old after new: rows of new replace those of their keys, but the columns in keep, which stay as they were where they were set; of several new rows the last by order counts."""
    others = [c for c in old.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("new"))
    df = old.withColumn("old", F.struct(*others)).select(*keys, "old").join(last, keys, "full")
    value = lambda c: F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")) if c in keep else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    return df.select(*keys, *(value(c).alias(c) for c in others))
