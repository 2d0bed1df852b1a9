"""How five text filters interact, whatever the order they are applied in.

Four filters look at a text alone; the fifth asks whether a text stands on a
smaller id. Each task counts its texts in a counting Bloom sketch, the sketches
are merged block by block, and a text with a cell that was hit once is unique
for certain. Only the others, possible repeats, are shuffled as whole texts, to
find the least id of each. A text's failures are a mask; counts by mask add up,
and every order's kept, removed and redundant texts follow from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, query, saved, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: The sketch: cells a text sets, all in one block of CELLS; blocks give each row CELLS_A_ROW cells.
PROBES, CELLS, CELLS_A_ROW = 4, 1 << 13, 12
#: The merged sketch, a bit for each cell, is broadcast; beyond so many bytes it doesn't grow, so that more unique texts are shuffled as possible repeats.
SKETCH_BYTES = 64 << 20
#: Cells that a task holds before it adds them up.
HELD = 2_000_000


def own_failures(text: Column) -> Column:
    """Bits 0 to 3: the text fails A, B, C, D. Words are maximal runs of characters that aren't ASCII white space."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, caps = F.size(words), F.length(text) - F.length(F.translate(text, UPPER, ""))
    failed = (n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * caps > 10 * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def text_key(text: Column) -> Column:
    """128 bits of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def cells_of(key: Column) -> Column:
    """The cells of a text within its block, of 13 bits each, in a long."""
    return F.xxhash64(F.lit(1), key)


def sketches(keys: DataFrame, blocks: int) -> DataFrame:
    """Each task's counting sketch: block, and its cells hit once and more often, as 16-bit numbers. Counts above two are as good as two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            block, bits = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            held += [block * CELLS + (bits >> 13 * i & CELLS - 1) for i in range(PROBES)]
            size += PROBES * len(block)
            if size >= HELD:
                yield from told(held)
                held, size = [], 0
        yield from told(held)

    def told(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
        block, first = np.unique(cell // CELLS, return_index=True)
        for a in range(0, len(block), 1000):
            rows = []
            for k in range(a, min(a + 1000, len(block))):
                own = slice(first[k], first[k + 1] if k + 1 < len(block) else len(cell))
                at = (cell[own] % CELLS).astype("<u2")
                rows.append((at[n[own] == 1].tobytes(), at[n[own] > 1].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(block[a : a + 1000], pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*rows))], names=["block", "once", "more"])

    return keys.mapInArrow(count, "block int, once binary, more binary")


def merged(parts: DataFrame) -> DataFrame:
    """block and bits, CELLS / 64 longs: the cells that all tasks together hit more than once. One block's counters are held at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, out = None, np.zeros(CELLS, np.uint8), []
        for batch in batches:
            for block, once, more in zip(*(batch.column(i) for i in range(3))):
                if block.as_py() != now:
                    out += [(now, counts)]
                    now, counts = block.as_py(), np.zeros(CELLS, np.uint8)
                one = np.frombuffer(once.as_py(), "<u2")
                counts[one] = np.minimum(counts[one] + 1, 2)
                counts[np.frombuffer(more.as_py(), "<u2")] = 2
            yield table_of(out)
            out = []
        yield table_of([(now, counts)])

    def table_of(out: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
        rows = [(b, np.packbits(c > 1, bitorder="little").view("<i8").tolist()) for b, c in out if b is not None and (c > 1).any()]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.list_(pa.int64()))], names=["block", "bits"])

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, bits array<long>")


def possible(df: DataFrame, sketch: DataFrame, blocks: int, key: str) -> DataFrame:
    """df and whether each row's key may occur twice: all its cells were hit more than once."""
    cell = lambda i: F.shiftright(cells_of(F.col(key)), 13 * i).bitwiseAND(CELLS - 1)
    bit = lambda i: F.call_function("shiftright", F.get("bits", F.shiftright(cell(i), 6).cast("int")), cell(i).bitwiseAND(63).cast("int"))
    hit = lambda i: bit(i).bitwiseAND(1) == 1
    joined = df.withColumn("block", block_of(F.col(key), blocks)).join(F.broadcast(sketch), "block", "left")
    every = hit(0)
    for i in range(1, PROBES):
        every = every & hit(i)
    return joined.select(*df.columns, F.coalesce(F.col("bits").isNotNull() & every, F.lit(False)).alias("possible"))


def first_ids(docs: DataFrame, sketch: DataFrame, blocks: int) -> DataFrame:
    """key and least id of each text that stands in docs (id, text) more than once: possible repeats are grouped by their whole text."""
    may = possible(docs.withColumn("key", text_key(F.col("text"))), sketch, blocks, "key").filter("possible")
    return may.groupBy("text").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").select(text_key(F.col("text")).alias("key"), "least")


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """part, mask (bits 0 to 4: fails A to E), n, good, toxic: how many rows of a part fail just these filters, and how many of those are labelled.

    E: a row of a smaller id has the same text, itself failing or not; rows
    without an id fail it never, nor do rows alike in id. A null text is empty,
    a null part an empty string. An id is good (toxic) if any of its label rows
    says 1. Repeated rows are rows; other columns, whatever their names, play
    no part. No documents give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text_key(text).alias("key"), own_failures(text).alias("mask"))
    narrow = saved(narrow, "failures")
    blocks = max(1, min(-(-narrow.count() * CELLS_A_ROW // CELLS), SKETCH_BYTES * 8 // CELLS))
    sketch = saved(merged(sketches(narrow.select(block_of(F.col("key"), blocks).alias("block"), cells_of(F.col("key")).alias("cells")), blocks)), "sketch")
    least = first_ids(docs.select(F.col(id_col).alias("id"), text.alias("text")), sketch, blocks)
    told = possible(narrow, sketch, blocks, "key")
    repeated = told.filter("possible").join(least, "key", "left").select("id", "part", (F.col("mask") + F.when(F.col("id") > F.col("least"), 16).otherwise(0)).alias("mask"))
    every = told.filter("NOT possible").select("id", "part", "mask").unionByName(repeated)
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(good_col) == 1).cast("int")).alias("good"), F.max((F.col(toxic_col) == 1).cast("int")).alias("toxic"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return every.join(known, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each step of each order, from masks()'s rows.

    shapley is the step's filter's removed texts, added up over all orders: of
    the m filters a text fails each stands first in 120 / m orders.
    """
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    bit = sum((F.when(letter == x, 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    before = sum((F.when(F.instr("filter_order", x) < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    df = counts.select("*", F.explode(F.split(F.lit(",".join(ORDERS)), ",")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    df = df.select("*", bit.alias("bit"), before.alias("before"))
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda when, what="n": F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("long")
    return df.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"),
        F.coalesce(F.sum(F.when(fails, F.col("n") * (F.lit(len(ORDERS)) / F.bit_count("mask")).cast("long"))), F.lit(0)).cast("long").alias("shapley"),
    )


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP12_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), least AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [CAST(len(words) < 100 AS INT), CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT), CAST(100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS INT),
     CAST(regexp_matches(text, '[#$%&*|]') AS INT), CAST(coalesce(d.doc_id > least, false) AS INT)] AS fails
  FROM d JOIN least USING (text) LEFT JOIN known ON d.doc_id = known.doc_id
), m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
o AS (SELECT unnest(string_split('{",".join(ORDERS)}', ',')) AS filter_order),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, instr('ABCDE', substr(filter_order, CAST(step AS INTEGER), 1)) AS i, [instr('ABCDE', x) FOR x IN string_split(substr(filter_order, 1, CAST(step AS INTEGER) - 1), '') IF x <> ''] AS earlier FROM o, range(1, 6) AS r(step)),
x AS (SELECT part, filter_order, step, n, good, toxic, fails[i] = 1 AS now, len([e FOR e IN earlier IF fails[e] = 1]) > 0 AS was, list_sum(fails) AS failed FROM m, s)
SELECT part, filter_order, step, CAST(sum(CASE WHEN NOT now AND NOT was THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN now AND NOT was THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN now AND was THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN now AND failed = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN now AND NOT was THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN now AND NOT was THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN now THEN n * (120 // failed) ELSE 0 END) AS BIGINT) AS shapley
FROM x GROUP BY part, filter_order, step
"""
