"""Benchmark decontamination by spaced seeds, with DataFrame functions alone.

A mask of SPAN positions ignores two of them, so windows that differ there by
substitutions have one hash. The masks together ignore each inner position, so
a lone substitution is always ignored by one. Training and test hashes meet in
a join against a benchmark part of bounded size, which gives the diagonals of
document and item that need a look; the tokens along each are compared once, and the stretch with the highest
score (1 a match, -MISMATCH a substitution) tells whether the passage is there.
Items too short for that are found where a document is the item, token by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, saved, table

#: Which positions of a window count.
MASKS = ("11101101", "11011011", "10110111")
SPAN = 8
MISMATCH, LEAST = 2, 9
#: Benchmark windows that are broadcast at once, some 60 bytes each; more go in parts, each a pass over the documents, and beyond MOST_PARTS documents' windows are shuffled to them instead.
WINDOWS_A_PART, MOST_PARTS = 2_000_000, 16
#: Bytes of hits, and of items' tokens, that are broadcast; beyond them the join shuffles.
SENT = 64 << 20
#: Items of more tokens are cut into stretches of so many, which overlap by LEAST - 1 tokens, so no passage of LEAST is lost; a passage over a cut is found in parts.
ITEM = 4096


def hashes(text: Column) -> Column:
    """A hash of each token: lower-cased runs of letters and digits."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda t: F.xxhash64(t))


def taken(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seeds(at: Column) -> Column:
    """The seeds of the window of h at at, by mask."""
    return F.array(*(F.xxhash64(F.lit(m), *(F.get("h", at + i) for i in taken(mask))) for m, mask in enumerate(MASKS)))


def windows(df: DataFrame) -> DataFrame:
    """at, mask and seed of each window of column h, beside df's columns. Outer explodes, as inner ones would have h computed once more for a filter."""
    starts = F.when(F.size("h") >= SPAN, F.sequence(F.lit(0), F.size("h") - SPAN))
    df = df.select("*", F.explode_outer(starts).alias("at"))
    df = df.select("*", F.posexplode_outer(seeds(F.col("at"))).alias("mask", "seed"))
    return df.filter(F.col("at").isNotNull())


def before() -> Column:
    """The seed of the window before, by the same mask; null of the first window."""
    return F.when(F.col("at") > 0, F.get(seeds(F.col("at") - 1), F.col("mask")))


def diagonals(docs: DataFrame, items: DataFrame, parts: int) -> DataFrame:
    """key, piece and shift (of the item's first token against the document's) of every diagonal of docs (key, h) and items (piece, h) with a window that a mask lets through.

    Of hits in a row on a diagonal the first stands for all: the windows before
    it differ. Items' windows are grouped by their seed and the seed before, so
    in a repeated text, where these are all alike, a window meets a group and
    not each of its windows.
    """
    out = None
    for p in range(parts):
        part = windows(items.filter(F.pmod(F.xxhash64("h"), F.lit(parts)) == p) if parts > 1 else items)
        part = part.select("piece", "at", F.col("seed").alias("b_seed"), before().alias("b_before")).groupBy("b_seed", "b_before").agg(F.collect_list(F.struct("piece", "at")).alias("places"))
        fresh = F.col("b_before").isNull() | (F.col("at") == 0) | (before() != F.col("b_before"))
        hits = windows(docs).join(F.broadcast(part), (F.col("seed") == F.col("b_seed")) & fresh)
        hits = hits.select("key", "at", F.explode("places").alias("place")).select("key", "place.piece", (F.col("at") - F.col("place.at")).alias("shift"))
        out = hits if out is None else out.unionByName(hits)
    return out.distinct()


def shuffled_diagonals(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As diagonals, in one pass over docs whatever the number of windows: those of both sides are shuffled by seed, without tokens."""
    own = windows(docs).select("key", "at", "seed", before().alias("before"))
    part = windows(items).select("piece", F.col("at").alias("b_at"), F.col("seed").alias("b_seed"), before().alias("b_before"))
    fresh = F.col("b_before").isNull() | F.col("before").isNull() | (F.col("before") != F.col("b_before"))
    return own.join(part, (F.col("seed") == F.col("b_seed")) & fresh).select("key", "piece", (F.col("at") - F.col("b_at")).alias("shift")).distinct()


def stretch() -> Column:
    """score, matched, start (in the document, from 0), length of the best stretch of d, the document's tokens on the diagonal, against b, the item's.

    Only where the two differ is a step: what lies between counts as a whole.
    """
    n = F.size("d")
    breaks = F.when(F.col("d") == F.col("b"), F.array(n)).otherwise(F.concat(F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.get("d", k) != F.get("b", k)), F.array(n)))
    zero = F.struct(*(F.lit(0).alias(x) for x in ("at", "run", "run_matched", "run_start", "score", "matched", "start", "length")))

    def step(acc: Column, k: Column) -> Column:
        fresh, same = acc["run"] <= 0, k - acc["at"]
        run = F.when(fresh, 0).otherwise(acc["run"]) + same
        matched = F.when(fresh, 0).otherwise(acc["run_matched"]) + same
        start = F.when(fresh, acc["at"]).otherwise(acc["run_start"])
        better = run > acc["score"]
        pick = lambda new, old: F.when(better, new).otherwise(acc[old]).alias(old)
        return F.struct(
            (k + 1).alias("at"), (run - MISMATCH).alias("run"), matched.alias("run_matched"), start.alias("run_start"),
            pick(run, "score"), pick(matched, "matched"), pick(F.greatest(F.col("shift"), F.lit(0)) + start, "start"), pick(k - start, "length"),
        )

    return F.aggregate(breaks, zero, step)


def sized(df: DataFrame, rows: int, bytes_a_row: int) -> DataFrame:
    """df, to be broadcast if it is small enough."""
    return F.broadcast(df) if rows * bytes_a_row <= SENT else df


def leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """doc_id, item_id, score, matched, start, length: the best stretch of each document and benchmark item that share one of LEAST or more.

    Stretches are counted in tokens; start is the document's token. An item of
    fewer than LEAST tokens (one at least) is found where it is the whole
    document; of ties the first stretch, then the longest, is told. Null and
    empty texts share nothing; null ids are kept; rows with one id are told
    together; other columns, whatever their names, play no part. However often
    tokens repeat in a document, in an item or in both, a diagonal of the two is
    compared once. Diagonals are written as narrow rows; only documents that
    have some are read by tokens again. Rows grow with documents times the
    items that share a passage with them.
    """
    # a key of more than one text only adds diagonals, which are compared like others
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    tokens = docs.select("key", "doc_id", hashes(F.col("text")).alias("h"))
    every = benchmark.select(F.col(item_col).alias("item_id"), hashes(F.coalesce(item_text_col, F.lit(""))).alias("h")).distinct()
    cuts = F.sequence(F.lit(0), F.greatest(F.size("h") - LEAST, F.lit(0)), F.lit(ITEM - LEAST + 1))
    items = every.filter(F.size("h") >= LEAST).select("item_id", F.explode(F.transform(cuts, lambda i: F.slice("h", i + 1, F.lit(ITEM)))).alias("h"))
    items = items.withColumn("piece", F.xxhash64("item_id", "h"))
    n = items.agg(F.sum(F.size("h"))).first()[0] or 0
    parts = max(1, -(-n * len(MASKS) // WINDOWS_A_PART))
    found = diagonals(tokens.select("key", "h"), items, parts) if parts <= MOST_PARTS else shuffled_diagonals(tokens.select("key", "h"), items)
    found = saved(found, "diagonals")
    # keys come first, so that tokens are made of no other document; and once of each, as an array's element, however many its diagonals
    n_found = found.count()
    held = docs.join(sized(found.select("key").distinct(), n_found, 48), "key", "left_semi").select("key", "doc_id", F.explode(F.array(hashes(F.col("text")))).alias("h"))
    held = held.join(sized(found, n_found, 48), "key").select("doc_id", "piece", "shift", "h")
    held = held.join(sized(items.select("item_id", "piece", F.col("h").alias("b_h")), n, 8), "piece")
    skipped = F.greatest(-F.col("shift"), F.lit(0))
    held = held.select("doc_id", "item_id", "shift", "b_h", F.slice("h", F.greatest(F.col("shift"), F.lit(0)) + 1, F.size("b_h") - skipped).alias("d"))
    held = held.select("doc_id", "item_id", "shift", "d", F.slice("b_h", skipped + 1, F.size("d")).alias("b"))
    walked = held.select("doc_id", "item_id", F.inline(F.array(stretch()))).filter(F.col("score") >= LEAST).drop("at", "run", "run_matched", "run_start")
    short = tokens.filter((F.size("h") > 0) & (F.size("h") < LEAST)).withColumn("h_key", F.xxhash64("h"))
    whole = every.filter((F.size("h") > 0) & (F.size("h") < LEAST)).select("item_id", F.col("h").alias("b_h"), F.xxhash64("h").alias("b_key"))
    size = F.size("h")
    out = short.join(whole, (F.col("h_key") == F.col("b_key")) & (F.col("h") == F.col("b_h"))).select("doc_id", "item_id", size.alias("score"), size.alias("matched"), F.lit(0).alias("start"), size.alias("length"))
    order = F.struct("score", "matched", (-F.col("start")).alias("minus"), "length")
    best = out.unionByName(walked).groupBy("doc_id", "item_id").agg(F.max(order).alias("s"))
    return best.select("doc_id", "item_id", F.col("s.score").cast("long").alias("score"), F.col("s.matched").cast("long").alias("matched"), (-F.col("s.minus")).cast("long").alias("start"), F.col("s.length").cast("long").alias("length"))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
