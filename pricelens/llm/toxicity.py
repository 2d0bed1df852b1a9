"""Toxicity by a factorization machine over hashed terms.

Terms are words and their beginnings, hashed into DIMS buckets; a sample of
labelled texts tells which buckets go with the label at all. On those the
machine learns a weight each and a vector each, whose products weigh pairs of
terms: what no term says alone, such as an insult beside a group's name or a
rare stem in a short text, a pair can say.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, query, saved, table

#: Buckets of terms, and beginnings of a word (characters) that are terms beside the word itself.
BITS, BEGINNINGS = 20, (3, 4, 5, 6, 7, 8)
DIMS = 1 << BITS
#: The classifier's sample: some so many labelled texts with the label and as many without it, chosen by hash.
SAMPLE = 8_000
#: Buckets that the machine sees: those of the highest likelihood ratio between the labels, from LEAST_RATIO on.
FEATURES, LEAST_RATIO = 2048, 20.0
#: Sizes of texts (powers of two of words), terms of their own.
SIZES = 24
FACTORS, EPOCHS, BATCH, RATE, SHRINK, SEED = 8, 30, 128, 0.05, 2e-4, 20240707
#: Characters that are hashed at once.
CHUNK = 200_000
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Terms:
    """(text's number, bucket) of all terms of texts; words are runs of letters and digits, in lower case."""

    def __init__(self):
        self.inside = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
        self.inside[0xD800:0xE000] = False
        self.power = self.back = np.ones(0, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * CHUNK)
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            one = np.ones(1, np.uint64)
            self.power, self.back = (np.concatenate([one, np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (BASE, inverse))

    def hashed(self, text: str) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Where each word of a lower-cased text begins, and (words' numbers, buckets) of each kind of term."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        word = np.zeros(len(code) + 2, bool)
        word[1:-1] = self.inside[code]
        edge = np.flatnonzero(word[1:] != word[:-1])
        first, last = edge[::2], edge[1::2]
        self.powers(len(code) + 1)
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * self.power[: len(code)], out=total[1:])
        size = last - first
        out = []
        for salt, n in enumerate((0, *BEGINNINGS)):
            at = np.arange(len(first)) if not n else np.flatnonzero(size >= n)
            a = first[at]
            h = (total[last[at] if not n else a + n] - total[a]) * self.back[a] + np.uint64(salt)
            h = (h ^ (h >> np.uint64(32))) * MIX
            out.append((at, (h ^ (h >> np.uint64(29))) * MIX >> np.uint64(64 - BITS)))
        return first, out

    def of(self, texts: Iterable[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text's number, texts, text's number from there of each term, its bucket) for runs of texts of about CHUNK characters; a long text comes in several runs."""
        held, size, n = [], 0, 0
        for i, text in enumerate(texts):
            for part in self.parts((text or "").lower()):
                if size + len(part) > CHUNK and held:
                    yield self.run(held)
                    held, size = [], 0
                held.append((i, part))
                size += len(part)
            n = i + 1
        if held:
            yield self.run(held)

    def parts(self, text: str) -> Iterator[str]:
        """A text in parts of about CHUNK characters, cut where no word is cut."""
        a = 0
        while len(text) - a > CHUNK:
            b = a + CHUNK
            while b < len(text) and text[b].isalnum():
                b += 1
            yield text[a:b]
            a = b
        yield text[a:]

    def run(self, held: list[tuple[int, str]]) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        """first text's number, texts, their words' counts, and each term's text and bucket."""
        at = np.array([i for i, _ in held])
        ends = np.cumsum([len(t) + 1 for _, t in held])
        starts, kinds = self.hashed("\n".join(t for _, t in held))
        owner = at[np.searchsorted(ends, starts, side="right")] - at[0]
        n = int(at[-1] - at[0]) + 1
        words = np.bincount(owner, minlength=n)
        return int(at[0]), n, words, np.concatenate([owner[k] for k, _ in kinds]), np.concatenate([b for _, b in kinds]).astype(np.int64)


def once(terms: Terms, texts: Iterable[str | None], slot: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(text's number, words, buckets, counts) for each text in turn; with slot, only terms whose slot isn't negative, by slot."""
    number, words, kept, counts = -1, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for first, n, size, owner, bucket in terms.of(texts):
        if slot is not None:
            bucket = slot[bucket]
            owner, bucket = owner[bucket >= 0], bucket[bucket >= 0]
        key, count = np.unique(owner * DIMS + bucket, return_counts=True)
        cut = np.searchsorted(key, np.arange(n + 1) * DIMS)
        for k in range(n):
            own, c = key[cut[k] : cut[k + 1]] - k * DIMS, count[cut[k] : cut[k + 1]]
            if first + k == number:  # a long text goes on
                kept, back = np.unique(np.concatenate([kept, own]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, c]), len(kept)).astype(np.int64)
                words += int(size[k])
                continue
            if number >= 0:
                yield number, words, kept, counts
            number, words, kept, counts = first + k, int(size[k]), own, c
    if number >= 0:
        yield number, words, kept, counts


def values(words: int, slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's features and their values: the logarithm of a term's count, and its size."""
    size = FEATURES + min(SIZES - 1, int(words).bit_length())
    return np.append(slots, size), np.append(np.log2(1.0 + counts), 1.0)


class Machine:
    """slot: each bucket's feature, or -1; bias, weight and a vector of FACTORS numbers for each feature."""

    def __init__(self, slot: np.ndarray, bias: float = 0.0):
        n = FEATURES + SIZES
        self.slot, self.bias = slot, bias
        self.weight = np.zeros(n)
        self.vector = np.random.default_rng(SEED).normal(0, 0.01, (n, FACTORS))

    def margin(self, x: np.ndarray) -> np.ndarray:
        both = x @ self.vector
        return self.bias + x @ self.weight + 0.5 * (both**2 - (x * x) @ self.vector**2).sum(1)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(dense(rows)), -35, 35)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, share: float) -> Machine:
        """Gradient steps on the log loss, each number's own rate falling with its gradients so far; rows weigh so that the label's share is that of all."""
        odds = np.random.default_rng(SEED)
        weigh = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
        seen = [np.full_like(self.weight, 1e-3), np.full_like(self.vector, 1e-3), 1e-3]
        for _ in range(EPOCHS):
            order = odds.permutation(len(rows))
            for a in range(0, len(rows), BATCH):
                at = order[a : a + BATCH]
                x = dense([rows[i] for i in at])
                g = (1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35))) - y[at]) * weigh[at] / len(at)
                used = np.flatnonzero(x.any(0))
                x = x[:, used]
                v = self.vector[used]
                dw = x.T @ g + SHRINK * self.weight[used]
                dv = x.T @ (g[:, None] * (x @ v)) - ((x * x).T @ g)[:, None] * v + SHRINK * v
                db = g.sum()
                seen[0][used] += dw**2
                seen[1][used] += dv**2
                seen[2] += db**2
                self.weight[used] -= RATE * dw / np.sqrt(seen[0][used])
                self.vector[used] -= RATE * dv / np.sqrt(seen[1][used])
                self.bias -= RATE * db / math.sqrt(seen[2])
        return self


def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), FEATURES + SIZES))
    for i, (slots, value) in enumerate(rows):
        x[i, slots] = value
    return x


def share_of(n: int) -> float:
    """The part of n rows with even hashes that gives SAMPLE rows; all of up to 6 standard deviations more."""
    return 1.0 if n <= SAMPLE + 6 * math.sqrt(SAMPLE) else SAMPLE / n


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fold: Column) -> tuple[DataFrame, float] | None:
    """key, text and y of the sample, and the label's share of all labelled ids; None if there are no such ids.

    An id is labelled 1 if any of its label rows says so. Ids are thinned by
    hash, so what is broadcast is bounded; rows alike in id and text are one,
    and where ids stand on several texts those are thinned by hash again.
    """
    id_ = F.col(id_col)
    known = labels.filter(id_.isNotNull() & F.col(label_col).isNotNull() & fold).groupBy(id_.alias("id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("y"))
    n = dict(known.groupBy("y").count().collect())  # two rows
    if not n:
        return None
    even = lambda key: F.shiftrightunsigned(key, 11) / float(1 << 53)
    part = lambda n: F.when(F.col("y") == 1, share_of(n.get(1, 0))).otherwise(share_of(n.get(0, 0)))
    thin = known.filter(even(F.xxhash64("id")) <= part(n))
    rows = docs.select(id_.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(thin), "id")
    rows = saved(rows.groupBy(F.xxhash64("id", "text").alias("key")).agg(F.first("text").alias("text"), F.max("y").alias("y")), "toxicity")
    return rows.filter(even(F.col("key")) <= part(dict(rows.groupBy("y").count().collect()))), n.get(1, 0) / sum(n.values())


def counts_by_bucket(sample: DataFrame) -> DataFrame:
    """bucket, with, without: texts of each label that have a term there, added up in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n = Terms(), np.zeros((2, DIMS), np.int64)
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for i, _, buckets, _ in once(terms, (x.as_py() for x in batch.column(0))):
                n[y[i], buckets] += 1
        full = np.flatnonzero(n.any(0))
        for a in range(0, len(full), 100_000):
            b = full[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(n[1, b]), pa.array(n[0, b])], names=["bucket", "with", "without"])

    return sample.select("text", "y").mapInArrow(count, "bucket long, with long, without long").groupBy("bucket").agg(F.sum("with").alias("with"), F.sum("without").alias("without"))


def chosen(counts: DataFrame, n: tuple[int, int]) -> np.ndarray:
    """The buckets' features: of the FEATURES highest likelihood ratios between the labels."""
    none, some = n
    cell = lambda seen, of: F.when((seen > 0) & (seen < of), seen * F.log(seen / F.lit(float(of))) + (of - seen) * F.log((of - seen) / F.lit(float(of)))).otherwise(0.0)
    w, o = F.col("with").cast("double"), F.col("without").cast("double")
    ratio = 2 * (cell(w, some) + cell(o, none) - cell(w + o, some + none))
    top = counts.select("bucket", ratio.alias("ratio")).filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.col("ratio").desc(), "bucket").limit(FEATURES).collect()
    slot = np.full(DIMS, -1, np.int64)
    slot[[r.bucket for r in top]] = np.arange(len(top))
    return slot


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fold: Column) -> Machine:
    """A machine fitted on the sample of labelled rows where fold holds; of one label only, or none, it learns their share alone (0 of none)."""
    spark = docs.sparkSession
    found = sampled(docs, labels, id_col, text_col, label_col, fold)
    empty = np.full(DIMS, -1, np.int64)
    if found is None:
        return Machine(empty, -35.0)
    sample, share = found
    n = dict(sample.groupBy("y").count().collect())
    if len(n) < 2:
        m = Machine(empty, 35.0 if share > 0.5 else -35.0)
        m.vector[:] = 0
        return m
    slot = chosen(counts_by_bucket(sample), (n[0], n[1]))
    sent = spark.sparkContext.broadcast(slot)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            rows = [values(w, s, c) for _, w, s, c in once(terms, (x.as_py() for x in batch.column(0)), sent.value)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([s.astype("<i2").tobytes() for s, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())], names=["y", "key", "slots", "value"])

    got = sorted(sample.select("text", "y", "key").mapInArrow(features, "y int, key long, slots binary, value binary").collect(), key=lambda r: (r.y, r.key))
    rows = [(np.frombuffer(r.slots, "<i2").astype(np.int64), np.frombuffer(r.value, "<f4").astype(float)) for r in got]
    return Machine(slot, math.log(max(share, 1e-6) / max(1 - share, 1e-6))).fit(rows, np.array([float(r.y) for r in got]), share)


def score_toxicity(docs: DataFrame, machine: Machine, text_col: str) -> Column:
    """The label's probability for each text, as a column over docs: only texts go to Python."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms, m = Terms(), sent.value
        for column in columns:
            out, held = [], []
            for _, w, s, c in once(terms, (x.as_py() for x in column), m.slot):
                held.append(values(w, s, c))
                if len(held) == BATCH:
                    out += [m.score(held)]
                    held = []
            out += [m.score(held)] if held else []
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score(F.col(text_col))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on) of every row of docs.

    Learns from label rows whose crc32(id) mod folds is not held; a null id is
    held out if held is 0 and has no label. Null and empty texts are scored as texts of no terms;
    repeated rows are rows, alike in score; where nothing could be learned all
    scores are next to 0; other columns, whatever their names, play no part.
    A text is held whole by one task, and hashed CHUNK characters at a time.
    """
    fold = crc_mod(id_col, folds) == held
    machine = train(docs, labels, id_col, text_col, label_col, ~fold)
    df = docs.select(F.col(id_col).alias("doc_id"), fold.alias("held_out"), F.col(text_col).alias("text"))
    df = df.select("doc_id", "held_out", score_toxicity(df, machine, "text").alias("score"))
    return df.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
