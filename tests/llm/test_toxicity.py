import re
from collections import Counter

import numpy as np
import pytest

from pricelens.llm import toxicity as T


def plain_terms(text):
    """(word or beginning, salt) counts by a regular expression."""
    out = Counter()
    for w in re.findall(r"[^\W_]+", text.lower()):
        out[w, 0] += 1
        for salt, n in enumerate(T.BEGINNINGS, 1):
            if len(w) >= n:
                out[w[:n], salt] += 1
    return out


def bucket(term, salt):
    h = sum((ord(c) + 1) * pow(int(T.BASE), i, 1 << 64) for i, c in enumerate(term)) + salt & (1 << 64) - 1
    h = (h ^ h >> 32) * int(T.MIX) & (1 << 64) - 1
    return ((h ^ h >> 29) * int(T.MIX) & (1 << 64) - 1) >> 64 - T.BITS


def told(texts, slot=None):
    return [(i, w, dict(zip(b.tolist(), c.tolist()))) for i, w, b, c in T.once(T.Terms(), texts, slot)]


def test_terms_are_those_of_plain_words(monkeypatch):
    texts = ["You idiot, you IDIOTS!", "", None, "a_b 12é x\u0000y \U0001f600 Straße 日本語の", "one " * 50, "z" * 300]
    for chunk in (200_000, 40):
        monkeypatch.setattr(T, "CHUNK", chunk)
        for (i, words, got), text in zip(told(texts), texts, strict=True):
            want = Counter()
            for (t, salt), n in plain_terms(text or "").items():
                want[bucket(t, salt)] += n
            assert got == want and words == len(re.findall(r"[^\W_]+", (text or "").lower()))


def test_margin_is_the_sum_over_pairs():
    m = T.Machine(np.full(T.DIMS, -1, np.int64), 0.3)
    odds = np.random.default_rng(1)
    m.weight, m.vector = odds.normal(size=m.weight.shape), odds.normal(size=m.vector.shape)
    slots, value = np.array([3, 8, 40]), np.array([1.0, 2.5, 0.5])
    pairs = sum(m.vector[slots[i]] @ m.vector[slots[j]] * value[i] * value[j] for i in range(3) for j in range(i))
    assert np.isclose(m.margin(T.dense([(slots, value)]))[0], 0.3 + m.weight[slots] @ value + pairs)


def test_pairs_are_learned_that_no_sum_of_weights_tells():
    """One of two terms is fine, both together are not."""
    rows, y = [], []
    for i in range(400):
        a, b = i % 2, i // 2 % 2
        slots = np.array([s for s, on in ((0, a), (1, b), (2, 1 - a), (3, 1 - b)) if on])
        rows.append((slots, np.ones(len(slots))))
        y.append(float(a == b))
    m = T.Machine(np.full(T.DIMS, -1, np.int64)).fit(rows, np.array(y), 0.5)
    assert ((m.score(rows) >= 0.5) == np.array(y)).all()


@pytest.fixture(scope="module")
def corpus(spark):
    odds = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = ["".join(odds.choice(list("bcdfg"), 5)) for _ in range(int(odds.integers(5, 80)))]
        if bad:
            words[2:2] = [str(odds.choice(["snark", "snarks", "snarkish"])), "boo"]
        docs.append((i, " ".join(words), "xx"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_texts_are_told(spark, corpus):
    docs, labels = corpus
    got = T.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert len(got) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 60 and np.mean([r.predicted == r.toxic for r in held]) > 0.97


def test_labels_of_the_held_out_are_not_learned(spark, corpus):
    from pyspark.sql import functions as F

    docs, labels = corpus
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    rows = lambda labels: sorted((r.doc_id, round(r.score, 9)) for r in T.toxicity(docs, labels).collect())
    assert rows(labels) == rows(turned)


def test_nulls_repeats_and_nothing_to_learn(spark, corpus):
    docs, labels = corpus
    more = docs.unionByName(spark.createDataFrame([(None, "snark boo", "x"), (9000, None, None), (9001, "", ""), (0, "other", "x"), (0, "other", "x")], docs.schema))
    more_labels = labels.unionByName(spark.createDataFrame([(None, 1), (0, None), (0, 1), (77777, 1)], labels.schema))
    got = T.toxicity(more, more_labels).collect()
    assert len(got) == 605 and all(r.score is not None for r in got)
    assert {r.predicted for r in got if r.doc_id is None} == {1} and {r.predicted for r in got if r.doc_id in (9000, 9001)} == {0}
    assert T.toxicity(docs.limit(0), labels).collect() == []
    assert {r.predicted for r in T.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert {r.predicted for r in T.toxicity(docs, labels.filter("toxic = 1")).collect()} == {1}
