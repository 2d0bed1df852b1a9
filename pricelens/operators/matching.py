"""Titles resolved to variants: aliases name a product, axis values its variant; name tokens make candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .titles import alias_hits, few, found, joined, normalize, tokens


def catalog(products: DataFrame, variants: DataFrame, axes: DataFrame) -> DataFrame:
    """product_id, tokens, variants (variant_id, wanted), demand (key, value) of products (product_id, name).

    variants holds (variant_id, product_id, axis_values), axes (id, product_id,
    axis_type, allowed_values); a product's first DEMAND axis by id counts. Of
    values with one normal form the last stands; empty ones are left out.
    """
    own = variants.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("variant_id", F.transform("axis_values", joined).alias("wanted")))).alias("variants"))
    demand = axes.filter(F.col("axis_type") == "DEMAND").groupBy("product_id").agg(F.min_by("allowed_values", "id").alias("values"))
    value = F.explode(F.transform("values", lambda v, i: F.struct(joined(v).alias("key"), v.alias("value"), i.alias("i"))))
    demand = demand.select("product_id", value.alias("v")).filter("v.key <> ''").groupBy("product_id", F.col("v.key").alias("key")).agg(F.max_by("v.value", "v.i").alias("value"))
    demand = demand.groupBy("product_id").agg(F.collect_list(F.struct("key", "value")).alias("demand"))
    return products.select("product_id", tokens(F.col("name")).alias("tokens")).join(own, "product_id", "left").join(demand, "product_id", "left")


def alias_keys(aliases: DataFrame) -> DataFrame:
    """key, product_id: aliases (id, product_id, alias) in normal form; of one form the last by id stands, those of no product don't count."""
    keyed = aliases.filter(F.col("product_id").isNotNull()).select("id", "product_id", joined(F.col("alias")).alias("key")).filter("key <> ''")
    return keyed.groupBy("key").agg(F.max_by("product_id", "id").alias("product_id"))


def fitting(known: DataFrame) -> Callable[[str, object], tuple]:
    """What tells of a title without spaces and its product the one variant all of whose wanted values are there and, beside it, the one demand value there; None without or with several. known, a few products of catalog(), goes to every task."""
    held = {}
    for r in known.select("product_id", "variants", "demand").collect():
        wanted = [(v.variant_id, v.wanted) for v in r.variants or () if v.wanted is not None and None not in v.wanted]
        held[r.product_id] = [(v, w[0]) for v, w in wanted if len(w) == 1], [(v, w) for v, w in wanted if len(w) != 1], [(d.key, d.value) for d in r.demand or ()]
    sent = known.sparkSession.sparkContext.broadcast(held)

    def one(j: str, product) -> tuple:
        single, several, demand = sent.value.get(product, ((), (), ()))
        fits = [v for v, w in single if w in j] + [v for v, ws in several if all(w in j for w in ws)]
        if len(fits) != 1:
            return None, None
        values = [value for key, value in demand if key in j]
        return fits[0], values[0] if len(values) == 1 else None

    return one


def match(posts: DataFrame, aliases: DataFrame, products: DataFrame, variants: DataFrame, axes: DataFrame) -> DataFrame:
    """post_id, tier, variant_id, candidates, demand_axis_value of posts (post_id, title).

    CONFIRMED: the aliases in the title are all one product's, and the axis
    values of exactly one of its variants are there (no values are always
    there). UNKNOWN: the product alone is known. CANDIDATE: no product by
    alias, but tokens of product names are tokens of the title. REJECTED: none.
    The demand value is set for confirmed posts whose title holds exactly one
    of the product's. Null titles are rejected; post_id must be unique. A
    small catalog is looked up in place, a larger one joined.
    """
    keys, words = alias_keys(aliases), products.select("product_id", F.explode(tokens(F.col("name"))).alias("w"))
    values = axes.filter(F.col("axis_type") == "DEMAND").select(F.explode("allowed_values"))
    if few(keys, words, variants, values, products):
        fields = T.StructField("variant_id", variants.schema["variant_id"].dataType), T.StructField("value", T.StringType())
        df = posts.select("post_id", found(normalize(F.col("title")), keys, words, fitting(catalog(products, variants, axes)), fields).alias("f"))
        own, near, variant = F.col("f.own"), F.col("f.near"), F.col("f.variant_id")
        tier = F.when(variant.isNotNull(), "CONFIRMED").when(own.isNotNull(), "UNKNOWN").when(F.size(near) > 0, "CANDIDATE").otherwise("REJECTED")
        candidates = F.when(variant.isNotNull(), None).when(own.isNotNull(), F.array(own)).when(F.size(near) > 0, near)
        return df.select("post_id", tier.alias("tier"), variant.alias("variant_id"), candidates.alias("candidates"), F.col("f.value").alias("demand_axis_value"))
    t = posts.select("post_id", joined(F.col("title")).alias("j"), tokens(F.col("title")).alias("words"))
    known = catalog(products, variants, axes)
    hits = alias_hits(t, keys).filter("n = 1").drop("n")
    named = t.join(hits, "post_id", "left")
    has = lambda v: F.col("j").contains(v)
    sure = named.filter("product_id IS NOT NULL").join(known.drop("tokens"), "product_id", "left")
    sure = sure.withColumn("fits", F.filter("variants", lambda v: F.forall(v["wanted"], has)))
    fits = F.col("fits")
    values = F.filter("demand", lambda d: has(d["key"]))
    one = F.size(fits) == 1
    sure = sure.select(
        "post_id", F.when(one, "CONFIRMED").otherwise("UNKNOWN").alias("tier"), F.when(one, F.get(fits, F.lit(0))["variant_id"]).alias("variant_id"),
        F.when(~F.coalesce(one, F.lit(False)), F.array("product_id")).alias("candidates"), F.when(one & (F.size(values) == 1), F.get(values, F.lit(0))["value"]).alias("demand_axis_value"),
    )
    rest = named.filter("product_id IS NULL")
    words = known.select("product_id", F.explode("tokens").alias("w"))
    near = rest.select("post_id", F.explode("words").alias("w")).join(words, "w").groupBy("post_id").agg(F.array_sort(F.collect_set("product_id")).alias("candidates"))
    some = F.col("candidates").isNotNull()
    none = F.lit(None)
    rest = rest.select("post_id").join(near, "post_id", "left").select("post_id", F.when(some, "CANDIDATE").otherwise("REJECTED").alias("tier"), none.cast(sure.schema["variant_id"].dataType).alias("variant_id"), "candidates", none.cast("string").alias("demand_axis_value"))
    return sure.unionByName(rest)


def learned_aliases(aliases: DataFrame, confirmed: DataFrame) -> DataFrame:
    """product_id, alias of confirmed titles (product_id, title) whose normal form is no alias's yet, once for each form and product."""
    new = confirmed.withColumn("key", joined(F.col("title"))).filter("key <> ''").groupBy("key", "product_id").agg(F.min("title").alias("alias"))
    return new.join(aliases.select(joined(F.col("alias")).alias("key")).distinct(), "key", "left_anti").select("product_id", "alias")


def demand_scope(deals: DataFrame, modes: DataFrame, value: Column | None = None) -> DataFrame:
    """deals of variants that are GROUPED, and of SPLIT ones those of the value asked for; modes holds (variant_id, demand_axis_mode).

    A deal without a value never matches, and a SPLIT variant without a value
    asked for is an error. Variants without a mode are GROUPED.
    """
    df = deals.join(modes, "variant_id", "left")
    split = F.coalesce(F.col("demand_axis_mode") == "SPLIT", F.lit(False))
    asked = F.lit(None).cast("string") if value is None else value
    df = df.withColumn("asked", F.when(split & asked.isNull(), F.raise_error(F.lit("a SPLIT variant needs a demand value")).cast("string")).otherwise(asked))
    return df.filter(~split | (F.col("demand_axis_value") == F.col("asked"))).drop("asked", "demand_axis_mode")
