"""Language ID by a linear-chain conditional random field over words.

A word's features are hashed affixes, all its character n-grams and, where the training
sample has it more than once, the word itself (the lexicon). Emission weights
and transitions are learned together by gradient descent on the likelihood of
code-switched sequences put together from pieces of the sample. Forward-backward
over all words of a text gives each word's distribution over the languages; a
text's language is the one with the largest sum.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, query, table

UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]+")
#: The classifier's sample: so many labelled texts of all languages together, shared out evenly, but at most and at least so many of each; a window of so many characters of each text.
SAMPLE, MOST_TEXTS, LEAST_TEXTS, SAMPLE_CHARS = 40_000, 600, 30, 1500
DIMS = 1 << 15
#: Training sequences: so many of each language, and in all at least.
SEQUENCES_A_LANG, SEQUENCES, PIECES, PIECE_WORDS, ROUNDS, RATE, SHRINK = 300, 1200, 4, (3, 25), 60, 0.15, 1e-4
#: Scores (a word's, one for each language), characters of new words, and distinct words that a worker holds at once.
CHUNK, SLICE, REMEMBERED = 1_500_000, 100_000, 100_000
#: Steps of forward-backward between two that keep numbers in range.
EVEN = 8
ODDS = np.random.default_rng(20240301).integers(1, 2**63, 4, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def hashed(runs: list[np.ndarray], salt: int) -> np.ndarray:
    """One of DIMS buckets for each run of characters, given as one array for each place in the run."""
    x = np.full(len(runs[0]), salt + 1, np.uint64)
    for i, c in enumerate(runs):
        x = (x ^ c) * ODDS[i]
        x ^= x >> np.uint64(29)
    return (x * ODDS[3] >> np.uint64(40)).astype(np.int64) % DIMS


def features(words: list[str], lexicon: frozenset[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word's number, bucket) of all features of words, some at a time: each two and three characters that adjoin in <word>,
    the first one to three, the last one to four, and the word where the lexicon has it.

    However long a word, all of it counts; SLICE characters are held at once.
    """
    text = "".join(f"<{w}>" for w in words)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    last = np.cumsum(size)
    first = last - size
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    for a in range(0, len(code), SLICE):
        at = np.arange(a, min(a + SLICE, len(code)))
        owner = np.searchsorted(last, at, side="right")
        for n in (2, 3):
            ok = at + n <= last[owner]
            yield owner[ok], hashed([code[at[ok] + i].astype(np.uint64) for i in range(n)], n)
    # four characters are hashed as three: the first two share a number
    every, pick = np.arange(len(words)), lambda at: code[at].astype(np.uint64)
    for n in (1, 2, 3):
        ok = size - 2 >= n
        yield every[ok], hashed([pick(first[ok] + 1 + i) for i in range(n)], 10 + n)
    for n in (1, 2, 3, 4):
        ok = size - 2 >= n
        runs = [pick(last[ok] - 2 - i) for i in range(n)]
        yield every[ok], hashed(runs if n < 4 else [runs[0] << np.uint64(32) | runs[1], *runs[2:]], 20 + n)
    ok = [i for i, w in enumerate(words) if w in lexicon]
    yield np.array(ok, np.int64), np.array([zlib.crc32(words[i].encode()) % DIMS for i in ok], np.int64)


class Crf:
    """labels, weights (DIMS x labels), start (labels), step (from x to), lexicon: bounded by DIMS, the number of languages and the sample."""

    def __init__(self, labels: list[str], lexicon: frozenset[str]):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights, self.start, self.step = np.zeros((DIMS, n)), np.zeros(n), np.zeros((n, n))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of words: the mean weight of their features, so that long words don't drown short ones, times a constant."""
        out, n = np.zeros((len(words), len(self.labels))), np.zeros(len(words))
        for owner, bucket in features(words, self.lexicon):
            n += np.bincount(owner, minlength=len(words))
            for k in range(len(self.labels)):
                out[:, k] += np.bincount(owner, self.weights[bucket, k], len(words))
        return out * (8 / np.maximum(n, 1))[:, None]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, step: np.ndarray, steps: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word distributions of sequences laid end to end; also, with steps, expected transitions, and each sequence's first row.

    Time step t handles all sequences longer than t at once.
    """
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    n = lengths[order]
    e = scores - scores.max(axis=1, keepdims=True)
    np.exp(e, out=e)
    a = np.exp(step - step.max())
    alpha, beta = np.empty_like(e), np.empty_like(e)
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(longest), side="left")  # sequences longer than t
    # every score is 1 at most and a step loses no more than the least transition, so rows need to be put to sum 1 only now and then
    x = np.exp(start - start.max())[None, :] * e[first]
    for t in range(longest):
        k = active[t]
        rows = first[:k] + t
        if t:
            x = x[:k] @ a
            x *= e[rows]
        if t % EVEN == 0:
            x /= x.sum(axis=1, keepdims=True)
        alpha[rows] = x
    expected = np.zeros_like(a)
    y = np.ones((len(first), e.shape[1]))
    for t in range(longest - 1, -1, -1):
        k = active[t]
        rows = first[:k] + t
        beta[rows] = y[:k]
        now = (y[:k] * e[rows]) @ a.T
        if t % EVEN == 0:
            now /= now.sum(axis=1, keepdims=True)
        y[:k] = now
    if not steps:
        alpha *= beta
        alpha /= alpha.sum(axis=1, keepdims=True)
        return alpha, expected, first
    out = alpha * beta
    out /= out.sum(axis=1, keepdims=True)
    inner = np.ones(len(e), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    if len(at):
        left, right = alpha[at - 1], e[at] * beta[at]
        z = np.einsum("ti,ij,tj->t", left, a, right)
        expected = np.einsum("ti,tj->ij", left / z[:, None], right) * a
    return out, expected, first


def fit(sample: list[tuple[str, str]], seed: int = 7) -> Crf:
    """A model from (text, language) pairs; one without labels from none. Adam on code-switched sequences of the sample's pieces."""
    texts = [(WORDS.findall(t.lower()), lang) for t, lang in sorted(sample)]
    texts = [(w, lang) for w, lang in texts if w]
    labels = sorted({lang for _, lang in texts})
    seen = Counter(x for w, _ in texts for x in set(w))
    crf = Crf(labels, frozenset(w for w, c in seen.items() if c > 1))
    if len(labels) < 2:
        return crf
    rng, by = np.random.default_rng(seed), [[] for _ in labels]
    of = {x: i for i, x in enumerate(labels)}
    for w, lang in texts:
        by[of[lang]].append(w)
    words: list[str] = []
    truth: list[int] = []
    lengths = []
    for s in range(max(SEQUENCES, SEQUENCES_A_LANG * len(labels))):
        n, lang = 0, s % len(labels)
        for _ in range(PIECES):
            w = by[lang][int(rng.integers(len(by[lang])))]
            size = min(len(w), int(rng.integers(*PIECE_WORDS)))
            at = int(rng.integers(len(w) - size + 1))
            words += w[at : at + size]
            truth += [lang] * size
            n += size
            if rng.random() < 0.5:
                lang = int(rng.integers(len(labels)))
        lengths.append(n)
    lengths, y = np.array(lengths), np.array(truth)
    types, back = np.unique(np.array(words, object).astype(str), return_inverse=True)
    owner, flat = (np.concatenate(x) for x in zip(*features(types.tolist(), crf.lexicon)))
    scale = 8 / np.maximum(np.bincount(owner, minlength=len(types)), 1)
    scored = lambda: np.stack([np.bincount(owner, crf.weights[flat, k], len(types)) * scale for k in range(len(labels))], 1)
    first = np.cumsum(lengths) - lengths
    same = np.ones(len(y), bool)
    same[first] = False
    at = np.flatnonzero(same)
    m = len(labels)
    seen_steps = np.bincount(y[at - 1] * m + y[at], minlength=m * m).reshape(m, m)
    seen_start = np.bincount(y[first], minlength=m)
    truth_by_type = np.stack([np.bincount(back, y == k, len(types)) for k in range(m)], 1)
    params = [crf.weights, crf.start, crf.step]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for r in range(1, ROUNDS + 1):
        p, steps, _ = forward_backward(scored()[back], lengths, crf.start, crf.step)
        short = (truth_by_type - np.stack([np.bincount(back, p[:, k], len(types)) for k in range(m)], 1)) * scale[:, None]
        grads = [np.stack([np.bincount(flat, short[owner, k], DIMS) for k in range(m)], 1), seen_start - p[first].sum(0), seen_steps - steps]
        for x, g, (u, v) in zip(params, grads, moments):
            g = g / len(y) - SHRINK * x
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            x += RATE * (u / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    crf.weights = crf.weights.astype(np.float32)
    return crf


class Tagger(dict):
    """Word -> row of scores; forgets all when it holds REMEMBERED words."""

    def __init__(self, crf: Crf):
        self.crf, self.new = crf, []
        self.scores = np.zeros((0, len(crf.labels)), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        return i

    def numbers(self, text: str | None) -> np.ndarray:
        """A number for each word; none for a text without a letter."""
        words = WORDS.findall((text or "").lower())
        if not any(c.isalpha() for w in words for c in w):
            return np.empty(0, np.int32)
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def learn(self) -> None:
        """Scores of the words that are new, SLICE characters or one word at a time."""
        parts, part, size = [self.scores], [], 0
        for i, w in enumerate(self.new):
            part.append(w)
            size += len(w)
            if size >= SLICE or i == len(self.new) - 1:
                parts.append(self.crf.emissions(part).astype(np.float32))
                part, size = [], 0
        self.scores, self.new = np.concatenate(parts), []

    def tag(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float, int, int]]:
        """(language, its share, words, switches) of each text, CHUNK scores of texts at a time."""
        most, held, size = max(1, CHUNK // max(1, len(self.crf.labels))), [], 0
        for t in texts:
            held.append(self.numbers(t))
            size += len(held[-1])
            if size >= most:
                yield from self.told(held)
                held, size = [], 0
        yield from self.told(held)

    def told(self, numbers: list[np.ndarray]) -> list[tuple[str, float, int, int]]:
        lengths = np.array([len(x) for x in numbers], np.int64)
        full = np.flatnonzero(lengths)
        labels = self.crf.labels
        out = [(UNKNOWN, 0.0, int(n), 0) for n in lengths]
        if labels and len(full):
            self.learn()
            n = lengths[full]
            p, _, _ = forward_backward(self.scores[np.concatenate(numbers)].astype(float), n, self.crf.start, self.crf.step, steps=False)
            first = np.cumsum(n) - n
            share = np.add.reduceat(p, first) / n[:, None]
            best = p.argmax(1)
            change = np.zeros(len(best), np.int64)
            change[1:] = best[1:] != best[:-1]
            change[first] = 0
            switches, top = np.add.reduceat(change, first), share.argmax(1)
            for j, i in enumerate(full):
                out[i] = (labels[top[j]], min(1.0, float(share[j, top[j]])), int(n[j]), int(switches[j]))
        if len(self) > REMEMBERED:  # only here, as no number is held any more
            self.clear()
            self.scores, self.new = self.scores[:0], []
        return out


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, where) -> Crf:
    """A model fitted on a bounded sample of the rows where where holds, chosen by hash, of every language that occurs.

    A language's rows are thinned by hash to a little more than its share before
    they are put in order, so a frequent one is no hot key; repeated rows of one
    id, text and language are one.
    """
    text, lang = F.col(text_col), F.col(lang_col)
    known = docs.filter(where & lang.isNotNull() & text.isNotNull()).select(lang.alias("lang"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    counts = known.groupBy("lang").agg(F.count("*").alias("rows")).collect()  # a row for each language
    if not counts:
        return fit([])
    share = max(LEAST_TEXTS, min(MOST_TEXTS, SAMPLE // len(counts)))
    # of n rows with even hashes, share + 6 standard deviations lie below the bound
    parts = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, min(1.0, (share + 6 * math.sqrt(share)) / r.rows)) for r in counts], "lang string, part double"))
    even = F.shiftrightunsigned(F.col("key"), 11) / float(1 << 53)
    window = F.substring("text", F.pmod("key", F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))).cast("int") + 1, F.lit(SAMPLE_CHARS))
    thin = known.join(parts, "lang").filter(even <= F.col("part")).groupBy("lang", "key").agg(F.first(window).alias("t"))
    order = Window.partitionBy("lang").orderBy("key", "t")
    rows = thin.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= share).select("t", "lang").collect()
    return fit([(r.t, r.lang) for r in rows])


def tag_languages(docs: DataFrame, crf: Crf, text_col: str) -> Column:
    """A struct of lang_pred, score, n_words and n_switches, as a column over docs: only the text goes to Python, and all else stays where it is."""
    # weights, lexicon and transitions travel once to each executor
    model = docs.sparkSession.sparkContext.broadcast(crf)
    kinds = [("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()), ("n_switches", pa.int64())]

    @F.arrow_udf("struct<lang_pred:string,score:double,n_words:long,n_switches:long>")
    def tag(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = Tagger(model.value)
        for column in columns:
            out = list(tagger.tag(x.as_py() for x in column))
            cols = list(zip(*out)) or [()] * 4
            yield pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(cols, kinds)], names=[n for n, _ in kinds])

    return tag(F.col(text_col))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words, n_switches of every row of docs.

    Learns from rows with a language whose crc32(id) mod folds is not held (a
    null id counts as 0); id, source and language never serve a prediction.
    Null texts and those without a letter are "und" with score 0, as are all
    where nothing could be learned; of equal shares the first language by name
    wins; repeated rows are rows; other columns, whatever their names, play no
    part. A text is held whole by one task, a few bytes of numbers for a word.
    """
    fold = crc_mod(id_col, folds) == held
    crf = train(docs, id_col, text_col, lang_col, ~fold)
    df = docs.select(F.col(id_col).alias("doc_id"), fold.alias("held_out"), F.col(text_col).alias("text"))
    return df.select("doc_id", "held_out", tag_languages(df, crf, "text").alias("told")).select("doc_id", "held_out", "told.*")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
