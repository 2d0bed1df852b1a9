import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from pricelens.llm import filter_audit as A

SCHEMA = "doc_id long, text string, lang string, part string, mask int, block string"


def row(i, text, lang="en"):
    return (i, text, lang, "clash", 99, "clash")


LONG = " ".join(f"w{i}" for i in range(120))
ROWS = [
    row(5, LONG), row(2, LONG), row(2, LONG), row(9, LONG, None), row(None, LONG, "de"), row(1, None), row(3, "", "de"), row(4, " \t\n "), row(6, "A B C", ""), row(7, "nbsp is no space \U0001f600" * 90),
    row(8, "low word " * 200), row(10, "HASH # " + LONG), row(11, "UP " * 150, "de"), row(12, "UP " * 150, "de"), row(13, LONG + " x|y", "de"), row(None, "alone"), row(14, "x" * 100_000 + " " + "Ab " * 5000),
]
LABELS = [(5, 1, 0), (2, 1, 1), (2, 0, None), (9, None, 1), (None, 1, 1), (1, 1, 0), (12, 0, 1), (7, 1, 1), (99, 1, 1)]


def brute(rows, labels):
    """Every order applied to every row."""
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for i, text, lang, *_ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and least[text] < i}
        parts[lang or ""].append((i, fails))
    out, shapley = {}, Counter()
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                ids = [i for i, _ in gone]
                out[part, order, step] = [len(left) - len(gone), len(gone), sum(fails[f] for _, fails in docs) - len(gone), sum(fails[f] and sum(fails.values()) == 1 for _, fails in docs), sum(i in good for i in ids), sum(i in toxic for i in ids)]
                shapley[part, f] += len(gone)
                left = [d for d in left if not d[1][f]]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def told(counts):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in A.interactions(counts).collect()}


@pytest.mark.parametrize("rate,held", [(12, 2_000_000), (1, 8)])
def test_all_orders_as_by_brute_force(spark, monkeypatch, rate, held):
    monkeypatch.setattr(A, "CELLS_A_ROW", rate)
    monkeypatch.setattr(A, "HELD", held)
    docs, labels = spark.createDataFrame(ROWS, SCHEMA).repartition(3), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert told(A.masks(docs, labels)) == brute(ROWS, LABELS)
    assert told(A.masks(docs, labels.limit(0))) == brute(ROWS, [])
    assert told(A.masks(docs.limit(0), labels)) == {}


def sketch_of(spark, df, blocks):
    parts = A.sketches(df.select(A.block_of(F.col("key"), blocks).alias("block"), A.cells_of(F.col("key")).alias("cells")), blocks)
    return parts, A.merged(parts)


@pytest.mark.parametrize("blocks", [1, 7, 40])
def test_unique_texts_are_cleared_and_no_repeat_is(spark, blocks):
    df = spark.range(20_000).select(A.text_key(F.concat(F.lit("t"), (F.when(F.col("id") % 10 == 0, F.col("id") % 300).otherwise(F.col("id"))).cast("string"))).alias("key")).repartition(5)
    _, sketch = sketch_of(spark, df, blocks)
    told = A.possible(df, sketch, blocks, "key").groupBy("key").agg(F.count("*").alias("n"), F.max("possible").alias("possible")).collect()
    assert all(r.possible for r in told if r.n > 1)
    cleared = sum(not r.possible for r in told if r.n == 1) / sum(r.n == 1 for r in told)
    assert cleared > 0.95 if blocks == 40 else cleared < 1


def test_sketches_hold_a_hot_text_in_a_few_cells(spark):
    df = spark.range(50_000).select(A.text_key(F.lit("same")).alias("key")).repartition(4)
    parts, sketch = sketch_of(spark, df, 10)
    assert parts.count() <= 4 and sketch.count() == 1
