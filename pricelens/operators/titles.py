"""Titles: normal forms, products found by alias, keywords that exclude or suggest themselves."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def normalize(title: Column) -> Column:
    """Capacities in one spelling; a unit letter counts where no letter, digit or underscore of ASCII follows."""
    t = F.replace(F.replace(title, F.lit("테라"), F.lit("TB")), F.lit("기가"), F.lit("GB"))
    return F.regexp_replace(F.regexp_replace(t, r"(\d)G(?![A-Za-z0-9_])", "$1GB"), r"(\d)T(?![A-Za-z0-9_])", "$1TB")


def joined(title: Column) -> Column:
    return F.regexp_replace(normalize(title), r"\s+", "")


def tokens(title: Column) -> Column:
    return F.array_distinct(F.split(F.trim(normalize(title)), r"\s+"))


#: Aliases that go to every task, as an automaton; more are joined by their beginnings.
MOST_ALIASES = 500_000
#: Lengths of beginnings; an alias is joined by the longest that it has.
HEADS = (1, 2, 4, 8, 16)


#: White space as the patterns above have it.
WHITE = re.compile(r"[ \t\n\x0b\f\r]+")


def few(*tables: DataFrame) -> bool:
    """Whether the tables together have at most MOST_ALIASES rows, so that a task may hold them."""
    left = MOST_ALIASES
    for t in tables:
        left -= t.limit(left + 1).count()
        if left < 0:
            return False
    return True


def found(title: Column, keys: DataFrame, words: DataFrame, more: Callable[[str, object], tuple] = lambda j, own: (), fields: tuple[T.StructField, ...] = ()) -> Column:
    """struct(own, near) of normal forms of titles: the product that all aliases within one (keys: key, product_id) name, null without or with several; near, where own is null, the products that its tokens (words: w, product_id) name, sorted; then fields, which more tells of a title without spaces and its own, null where own is.

    Both tables, MOST_ALIASES rows at most, go to every task; titles are read
    where they are, without a shuffle.
    """
    kind = keys.schema["product_id"].dataType
    known = sorted({(r.key, r.product_id) for r in keys.select("key", "product_id").collect()}, key=lambda x: x[0])
    sent = keys.sparkSession.sparkContext.broadcast((known, words.select("w", "product_id").distinct().collect()))
    out = T.StructType([T.StructField("own", kind), T.StructField("near", T.ArrayType(kind)), *fields])
    none = (None,) * len(fields)

    @F.arrow_udf(out)
    def read(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        keys, tokens = ahocorasick.Automaton(), {}
        for key, rows in groupby(sent.value[0], key=lambda x: x[0]):
            keys.add_word(key, [p for _, p in rows])
        if len(keys):
            keys.make_automaton()
        for w, p in sent.value[1]:
            tokens.setdefault(w, set()).add(p)

        def one(t: str | None) -> tuple:
            if t is None:
                return None, [], *none
            j = WHITE.sub("", t)
            own = {p for _, ps in keys.iter(j) for p in ps} if j and len(keys) else ()
            if len(own) == 1:
                (p,) = own
                return p, None, *more(j, p)
            return None, sorted(set().union(*(tokens.get(w, ()) for w in WHITE.split(t.strip(" "))))), *none

        for column in columns:
            rows = [one(t) for t in column.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in rows], to_arrow_type(f.dataType)) for i, f in enumerate(out)], out.names)

    return read(title)


def alias_hits(posts: DataFrame, keys: DataFrame) -> DataFrame:
    """post_id, n, product_id: how many products the aliases within a title (column j) name, and the least.

    Up to MOST_ALIASES aliases are one automaton, which reads a title once
    whatever their number and lengths. Beyond that a title's places are joined
    with the aliases' beginnings, and where these are equal the whole alias is
    compared: a row for each character and length of beginning.
    """
    met = alias_scan(posts, keys) if few(keys) else alias_join(posts, keys)
    return met.groupBy("post_id").agg(F.count_distinct("product_id").alias("n"), F.min("product_id").alias("product_id"))


def alias_scan(posts: DataFrame, keys: DataFrame) -> DataFrame:
    """post_id and product_id of aliases within j, by an automaton in each task: only titles go to Python, no title is shuffled."""
    kind = keys.schema["product_id"].dataType
    known = sorted({(r.key, r.product_id) for r in keys.select("key", "product_id").collect()}, key=lambda x: x[0])  # MOST_ALIASES at most
    sent = posts.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf(T.ArrayType(kind))
    def products(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for key, rows in groupby(sent.value, key=lambda x: x[0]):
            found.add_word(key, [p for _, p in rows])
        if len(found):
            found.make_automaton()
        for column in columns:
            titles = (x.as_py() for x in column)
            yield pa.array([sorted({p for _, ps in found.iter(t) for p in ps}) if t and len(found) else [] for t in titles], to_arrow_type(T.ArrayType(kind)))

    return posts.select("post_id", F.explode(products("j")).alias("product_id"))


def alias_join(posts: DataFrame, keys: DataFrame) -> DataFrame:
    """post_id and product_id of aliases within j, by joins of beginnings."""
    size = F.length("key")
    head = lambda n: (size >= n) & ((size < 2 * n) if n < HEADS[-1] else F.lit(True))
    sizes = [n for n in HEADS if not keys.filter(head(n)).isEmpty()]
    out = None
    for n in sizes:
        places = F.transform(F.sequence(F.lit(1), F.length("j") - n + 1), lambda i: F.struct(i.alias("i"), F.substring(F.col("j"), i, F.lit(n)).alias("head")))  # noqa: B023  Spark calls it at once
        at = posts.filter(F.length("j") >= n).select("post_id", "j", F.explode(places).alias("at")).select("post_id", "j", "at.*")
        met = at.join(keys.filter(head(n)).withColumn("head", F.substring("key", 1, n)), "head").filter(F.substring(F.col("j"), F.col("i"), F.length("key")) == F.col("key")).select("post_id", "product_id")
        out = met if out is None else out.unionByName(met)
    return out if out is not None else posts.join(keys, F.lit(False)).select("post_id", "product_id")


def match_products(posts: DataFrame, aliases: DataFrame, catalog: DataFrame) -> DataFrame:
    """post_id, tier, product: CONFIRMED where the aliases in a title are all one product's, else CANDIDATE with the least product a token of whose name is a token of the title, else REJECTED.

    post_id must be unique. A catalog of few aliases and tokens is looked up
    in place; of a larger one an alias hit is found as in alias_hits, and both
    are joined.
    """
    keys = aliases.filter(F.col("product").isNotNull()).select(joined(F.col("alias")).alias("key"), F.col("product").alias("product_id")).filter("key <> ''").distinct()
    # of a token's products only the least can be the title's
    names = catalog.select("product", F.explode(tokens(F.col("name"))).alias("w")).groupBy("w").agg(F.min("product").alias("product_id"))
    if few(keys, names):
        df = posts.select("post_id", found(normalize(F.col("title")), keys, names).alias("f"))
        df = df.select("post_id", F.when(F.col("f.own").isNotNull(), 1).alias("n"), F.col("f.own").alias("own"), F.get("f.near", F.lit(0)).alias("near"))
    else:
        hits = alias_hits(posts.select("post_id", joined(F.col("title")).alias("j")), keys).withColumnRenamed("product_id", "own")
        words = posts.select("post_id", F.explode(tokens(F.col("title"))).alias("w"))
        near = words.join(names, "w").groupBy("post_id").agg(F.min("product_id").alias("near"))
        df = posts.select("post_id").join(hits, "post_id", "left").join(near, "post_id", "left")
    tier = F.when(F.col("n") == 1, "CONFIRMED").when(F.col("near").isNotNull(), "CANDIDATE").otherwise("REJECTED")
    return df.select("post_id", tier.alias("tier"), F.when(F.col("n") == 1, F.col("own")).otherwise(F.col("near")).alias("product"))


def exclude_keywords(deals: DataFrame, posts: DataFrame, keywords: DataFrame) -> DataFrame:
    """Deals none of whose posts' titles holds a keyword of the deal's variant or of all (a null variant). Keywords are trimmed, empty ones dropped."""
    words = keywords.select("variant_id", F.trim("keyword").alias("k")).filter("k <> ''")
    own = words.filter("variant_id IS NOT NULL").groupBy("variant_id").agg(F.collect_set("k").alias("own"))
    common = [r.k for r in words.filter("variant_id IS NULL").select("k").distinct().collect()]  # one setting, kept by hand
    linked = deals.select("deal_id", "variant_id").join(posts.select("deal_id", "title"), "deal_id").join(own, "variant_id", "left")
    every = F.concat(F.coalesce("own", F.array().cast("array<string>")), F.array(*map(F.lit, common)).cast("array<string>"))
    bad = linked.filter(F.exists(every, lambda k: F.col("title").contains(k))).select("deal_id").distinct()
    return deals.join(bad, "deal_id", "left_anti")


def suggested_rows(ignored: DataFrame, known: DataFrame, pinned: DataFrame, id_col: str, least: int = 2) -> DataFrame:
    """variant_id, keyword, titles: tokens of two characters or more, with a letter, in least ignored titles of a variant, that aren't known; titles of pinned deals (id_col) don't count, and a title counts a token once."""
    words = ignored.join(pinned, id_col, "left_anti").select("variant_id", F.explode(F.array_distinct(F.split(F.regexp_replace("title", r"^\s+|\s+$", ""), r"\s+"))).alias("keyword"))
    words = words.filter((F.length("keyword") >= 2) & F.col("keyword").rlike("[A-Za-z가-힣]")).join(known.select("keyword"), "keyword", "left_anti")
    return words.groupBy("variant_id", "keyword").agg(F.count("*").alias("titles")).filter(F.col("titles") >= least)


def suggest_keywords(ignored: DataFrame, known: DataFrame, pinned: DataFrame, id_col: str, least: int = 2) -> DataFrame:
    """variant_id, candidates: the keywords of suggested_rows of a variant as one sorted list, as the review queue takes them."""
    return suggested_rows(ignored, known, pinned, id_col, least).groupBy("variant_id").agg(F.array_sort(F.collect_list("keyword")).alias("candidates"))


def split_digest(text: Column, most: int) -> Column:
    """Parts of whole lines under most characters less 10; a longer line is a part by itself; parts are numbered where there are several."""
    room = most - 10
    add = lambda acc, line: F.when(F.length(F.element_at(acc, -1)) + F.length(line) + 1 <= room, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit("\n"), line)))).otherwise(F.concat(acc, F.array(line)))
    lines = F.split(text, "\n", -1)
    parts = F.aggregate(F.slice(lines, F.lit(2), F.size(lines)), F.slice(lines, 1, 1), add)
    numbered = F.transform(parts, lambda p, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit("/"), F.size(parts).cast("string"), F.lit(") "), p))
    return F.when(F.size(parts) > 1, numbered).otherwise(parts)
