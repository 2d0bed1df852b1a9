"""Near-duplicates by an inverted join over MinHash coordinates, confirmed on full sets.

Texts with one word sequence are one class first. A class posts itself under
coordinate-value pairs. Links at the threshold match in at least MATCHES of
KEYS coordinates (but for a chance of about 1 in 10^7, MISS standard deviations),
so two that match must meet in the KEYS - MATCHES + 1 coordinates that come
first in an order common to all, rare values before frequent ones (prefix). The
other lists are skipped: their collisions are counted from the two signatures.

Whole lists are never paired off. Each member first meets two hubs of its
list; links confirmed on the full sets make components. Members that still
match one of another component are then found by a semi-join, and among their
full sets alone the pairs across components that can be links: an exact prefix
and position filter over rare shingles, set against a list's members outside
its largest component. Every link thus lies within a component or has been
confirmed or refuted on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import query, saved, table
from .components import components
from .words import Hashes, chunks

KEYS, MISS = 64, 6.0
BUCKETS = 1 << 16
#: For shingles; their counts come to the driver as 16 bytes each.
RARE_BUCKETS = 1 << 20
#: Below so many ids a filter on ids is broadcast (8 bytes each), else joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Members that meet one hub in one group, so that no task gets all of a hub's.
MEMBERS_A_GROUP = 200
U = np.uint64
ODDS = (np.random.default_rng(20240229).integers(1, 2**63, KEYS + 32, dtype=np.uint64) << U(1)) | U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def shingles(words: list[bytes], known: Hashes, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of size words; of the whole sequence where it is shorter; none without words."""
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(known.__getitem__, words), np.int64, len(words)).view(U)
    n = min(size, len(words))
    x = np.full(len(h) - n + 1, n, U)
    for i in range(n):
        x = x * ODDS[KEYS + i % 32] + h[i : len(h) - n + 1 + i] * ODDS[KEYS + (i + 7) % 32]
    return np.unique(mixed(x))


def coordinates(s: np.ndarray) -> np.ndarray:
    """The least value of each of KEYS orders of the set, as keys that tell the coordinate too."""
    low = np.full(KEYS, 2**64 - 1, U)
    for a in range(0, len(s), 2048):
        low = np.minimum(low, (s[a : a + 2048, None] * ODDS[None, :KEYS]).min(0))
    return mixed(low + np.arange(KEYS, dtype=U) * U(0x9E3779B97F4A7C15))


def needed(num: int, den: int) -> int:
    """Matches that a pair at the threshold reaches, MISS standard deviations below the mean allowed for."""
    p = num / den
    return max(1, min(KEYS, math.floor(KEYS * p - MISS * math.sqrt(KEYS * p * (1 - p)))))


def matches(a: Column, b: Column) -> Column:
    """Equal bytes of two signatures of KEYS bytes in longs."""
    total = F.lit(KEYS)
    for i in range(KEYS // 8):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for shift in (4, 2, 1):  # afterwards a byte's lowest bit tells whether any of its bits was set
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def base_rows(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, seq (128 bits of the word sequence), n (set size), keys of docs' columns doc_id and raw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = Hashes()
        for batch in batches:
            for first, rows in chunks(batch.column("raw")):
                sets = [shingles(w, known, size) for w in rows]
                keys = [coordinates(s).view(np.int64) if len(s) else [] for s in sets]
                cols = [batch.column("doc_id").slice(first, len(rows)), pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in rows], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "seq", "n", "keys"])

    return docs.mapInArrow(run, "doc_id long, seq binary, n long, keys array<long>")


def posts(classes: DataFrame, prefix: int) -> DataFrame:
    """id, n, first (the prefix of its keys), sig of each class: the order puts keys of rarer buckets first."""
    counts = np.zeros(BUCKETS, np.int64)
    for r in classes.select(F.explode("keys").alias("k")).groupBy(F.col("k").bitwiseAND(BUCKETS - 1).alias("b")).agg(F.count("*").alias("n")).collect():
        counts[r.b] = r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            keys = b.column("keys").flatten().to_numpy().reshape(-1, KEYS)
            order = np.lexsort((keys, counts[keys & (BUCKETS - 1)]), axis=1)[:, :prefix]
            first = np.take_along_axis(keys, order, 1)
            sig = np.ascontiguousarray((keys.view(U) >> U(56)).astype(np.uint8)).view("<i8")
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (first, sig)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), *lists], names=["id", "n", "first", "sig"])

    return classes.mapInArrow(run, "id long, n long, first array<long>, sig array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, s (the sorted full set as bytes) of the documents in ids (column id), made from their texts."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            for first, rows in chunks(batch.column("raw")):
                made = pa.array([shingles(w, known, size).tobytes() for w in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(rows)), made], names=["id", "s"])

    return texts.mapInArrow(run, "id long, s binary")


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets have den * intersection >= num * union.

    Each set goes to its pair's group: members that meet one a, MEMBERS_A_GROUP
    or so together, so a's set travels once for all of them.
    """
    wide = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS_A_GROUP).alias("groups"))
    pairs = pairs.join(wide, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("g"))
    ends = pairs.select("a", "g", F.col("b").alias("id")).unionByName(pairs.select("a", "g", F.col("a").alias("id")).distinct())

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(s=[np.frombuffer(x, U) for x in frame["s"]])
        own, out = frame.loc[frame["id"] == key[0], "s"].tolist(), set()
        for i, s in zip(frame["id"], frame["s"]):
            for o in own if i != key[0] else ():
                both = int((o[np.minimum(np.searchsorted(o, s), len(o) - 1)] == s).sum()) if len(o) else 0
                if both and den * both >= num * (len(o) + len(s) - both):
                    out.add(i)
        return pd.DataFrame({"a": [key[0]] * len(out), "b": sorted(out)}).astype("int64")

    return ends.join(sets, "id").groupBy("a", "g").applyInPandas(compare, "a long, b long")


def rare_shingles(sets: DataFrame, num: int, den: int) -> DataFrame:
    """id, n, x, at, before: of each set the rarest shingles x, at their places, of which linked sets share one; before is the one before.

    Sets whose overlap must reach o = num/den of their size share one of the
    first n - o + 1 in any common order; here rare buckets come first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = np.frombuffer(b"".join(b.column("s").to_pylist()), U)
            bucket, n = np.unique(every & U(RARE_BUCKETS - 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(n)], names=["b", "n"])

    counts = np.zeros(RARE_BUCKETS, np.int64)
    told = sets.mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    counts[told.column("b").to_numpy()] = told.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in batches:
            ids, raw = b.column("id").to_numpy(), b.column("s").to_pylist()
            firsts = []
            for x in raw:
                s = np.frombuffer(x, U)
                firsts.append(s[np.lexsort((s, counts[s & U(RARE_BUCKETS - 1)]))][: len(s) - -(-num * len(s) // den) + 1])
            n = [len(x) for x in firsts]
            x, at = np.concatenate([*firsts, np.empty(0, U)]).view(np.int64), np.concatenate([np.arange(k) for k in n] + [np.empty(0, np.int64)])
            before = pa.array(np.concatenate([x[:1], x[:-1]]), mask=at == 0)
            cols = [np.repeat(ids, n), np.repeat([len(x) // 8 for x in raw], n), x, at]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in cols), before], names=["id", "n", "x", "at", "before"])

    return sets.mapInArrow(run, "id long, n long, x long, at long, before long")


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable), kept of every row of docs.

    Links hold between texts whose sets of size-word shingles (of ASCII
    white-space words, A-Z lowered) have den * intersection >= num * union.
    Null and empty texts and those without words have no shingles and no
    links. Rows that share an id are one document, linked if any of its texts
    is; rows without an id take their text's component (null if all of it are
    such) and are not kept. Other columns, whatever their names, play no part.
    With exact the second round takes every class, not only those whose
    signatures match, so that no link hangs on chance; it shuffles about
    (1 - num/den) of all shingles then.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("raw"))
    base = saved(base_rows(docs, size), "minhash")
    full = base.filter("n > 0")
    # n and keys follow from seq, so any row's will do
    classes = saved(full.groupBy("seq").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    least = needed(num, den)
    post = saved(posts(classes.filter("id IS NOT NULL").select("id", "n", "keys"), KEYS - least + 1), "posts")
    near = lambda a, b: (F.least(a["n"], b["n"]) * den >= F.greatest(a["n"], b["n"]) * num) & (matches(a["sig"], b["sig"]) >= least)

    # lists of two members or more, each with its length
    listed = post.select("id", F.explode("first").alias("key"))
    lengths = listed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    listed = saved(listed.join(lengths, "key"), "listed")

    # round 1: two hubs of each list, the member whose lists are longest together and the least
    mass = listed.groupBy("id").agg(F.sum("size").alias("mass"))
    hubs = listed.join(mass, "id").groupBy("key").agg(F.max(F.struct("mass", (-F.col("id")).alias("minus"))).alias("top"), F.min("id").alias("low"))
    pairs = listed.join(hubs, "key").select("id", F.explode(F.array(-F.col("top.minus"), F.col("low"))).alias("hub")).filter("id <> hub").distinct()
    one, two = F.struct("n", "sig").alias("x"), F.struct("n", "sig").alias("y")
    pairs = pairs.join(post.select("id", one), "id").join(post.select(F.col("id").alias("hub"), two), "hub").filter(near(F.col("x"), F.col("y")))
    best = Window.partitionBy("id").orderBy(F.desc("m"), "hub")
    pairs = pairs.select("id", "hub", matches(F.col("x.sig"), F.col("y.sig")).alias("m")).withColumn("r", F.row_number().over(best)).filter("r <= 2")
    tried = saved(pairs.select(F.col("hub").alias("a"), F.col("id").alias("b")), "tried")
    ends = tried.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = saved(confirmed(tried, full_sets(docs, ends, size), num, den), "links")

    # round 2: members that still match another component's in a list; each is told once, however many it matches
    parts = components(links)
    own = lambda df: df.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    listed = own(listed.select("key", "id"))
    mixed_lists = listed.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least <> most").select("key")
    open_lists = saved(listed.join(mixed_lists, "key", "left_semi").join(post.select("id", F.struct("n", "sig").alias("x")), "id"), "open")
    mine, other = open_lists.alias("i"), open_lists.alias("j")
    apart = (F.col("i.key") == F.col("j.key")) & (F.col("i.c") != F.col("j.c")) & near(F.col("i.x"), F.col("j.x"))
    left = classes.filter("id IS NOT NULL").select("id") if exact else mine.join(other, apart, "left_semi").select("id").distinct()
    # of these the full sets decide: pairs that share a rare shingle early enough for the overlap they need
    sets = saved(full_sets(docs, saved(left, "left"), size), "sets")
    rare = saved(own(rare_shingles(sets, num, den)), "rare")
    major = rare.groupBy("x", "c").agg(F.count("*").alias("size")).groupBy("x").agg(F.max(F.struct("size", "c")).alias("top"), F.count("*").alias("kinds")).filter("kinds > 1")
    outer = rare.join(major.select("x", F.col("top.c").alias("major")), "x").filter("c <> major").alias("i")
    overlap = F.least(F.col("i.n") - F.col("i.at"), F.col("j.n") - F.col("j.at"))  # at most, if this is the first they share
    enough = overlap * (num + den) >= num * (F.col("i.n") + F.col("j.n"))
    fresh = ~F.coalesce(F.col("i.before") == F.col("j.before"), F.lit(False))  # else x isn't the first they share
    met = outer.join(rare.alias("j"), (F.col("i.x") == F.col("j.x")) & (F.col("i.c") != F.col("j.c")) & enough & fresh)
    met = met.select(F.least("i.id", "j.id").alias("a"), F.greatest("i.id", "j.id").alias("b")).distinct()
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = saved(met.join(done, ["a", "b"], "left_anti"), "tried")
    parts = components(links.unionByName(confirmed(more, sets, num, den)))

    named = classes.select("seq", "id").join(parts.withColumnRenamed("node", "id"), "id", "left").select("seq", F.coalesce("component", "id").alias("component"))
    out = base.select("doc_id", "seq", "n").join(named, "seq", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


#: Sets of shingles, pairs that share one, links by the exact share of the union, and the least id reached by recursion.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS x FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), k AS (SELECT doc_id, md5(CAST(x AS VARCHAR)) AS x FROM s),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM k a JOIN k b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) c USING (doc_id)
"""


@query
def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, num=85)
