"""Interpolated modified Kneser-Ney trigram model, counted in Spark.

Training leaves tables of sorted hash arrays in the shared folder, each cut
into shards by hash, which workers map into memory to score texts:

    words      hash of every training word -> its count; a word's id is its rank
    grams-3    hash of (a, b, c) -> how often c follows a b, where more does
    grams-2    hash of (b, c) -> how many words precede b c (how often, at a text's start)
    single-k   hash of the words before that only one word follows, and once -> that word
    whole-k    hash of other words before -> their n-grams' counts, in all and seen once, twice, more
    spread-k   the same of words so frequent that their n-grams are in many shards
    ones       word -> how many words precede it

Spark does the counting: a task sums what it reads and sends each shard one
packed block for about RUN tokens; a shard is summed, sorted and written by one
task, which passes on what the next lower order counts. Every training word has
its own id; one outcome besides stands for all others, so that the model, like
the base score, is a distribution over the training words and that outcome.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, query, shared_dir, table
from .words import Hashes, chunks, hash63

#: Tokens that a shard holds on average, and that a worker takes together.
TOKENS_A_SHARD, RUN = 2_000_000, 1_000_000
U = np.uint64
ODDS = (U(0x9E3779B97F4A7C15), U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53))
#: No word holds a space.
END = hash63(b" end")
BLOCK = "kind int, shard long, data binary"
OWN, LOWER, SPREAD, SPREAD_LOWER = 0, 1, 2, 3
#: Words, the most frequent of all or nearly, that have short codes in blocks.
FREQUENT = 1 << 16
CONTEXT = ("total", "n1", "n2", "n3")


def mix(*ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of rows of ids."""
    x = np.zeros(len(ids[0]), U)
    for c in ids:
        x = (x ^ c.astype(U)) * ODDS[0]
        x = (x ^ (x >> U(32))) * ODDS[1]
    return (x ^ (x >> U(29))) * ODDS[2]


def hashed(rows: list[list[bytes]], known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and each text's number of tokens."""
    n = np.fromiter((len(x) + 1 for x in rows), np.int64, len(rows))
    out = np.empty(int(n.sum()), np.int64)
    at = 0
    for words in rows:
        out[at : at + len(words)] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        at += len(words) + 1
        out[at - 1] = END
    return out, n


def previous(tokens: np.ndarray, n: np.ndarray, begin: int) -> np.ndarray:
    """The token before each, begin at a text's first."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(n) - n] = begin
    return out


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of one row of each, and the sum of its rows' n."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[start], order[start], np.add.reduceat(n[order], start) if len(start) else n[:0]


def packed(*columns: np.ndarray) -> bytes:
    """Columns of integers as bytes, like bytes together, compressed; the first as differences."""
    x = np.stack(columns).astype("<i8")
    x[0, 1:] -= x[0, :-1].copy()
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, columns: int) -> np.ndarray:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(columns, 8, -1).transpose(0, 2, 1)).view("<i8")[:, :, 0].copy()
    np.cumsum(x[0], out=x[0])
    return x


def blocks(kind: int, shard: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """BLOCK rows: the columns' rows by shard."""
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")
    shard, columns = shard[order], [c[order] for c in columns]
    cuts = [*np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])[: len(shard)]).tolist(), len(shard)]
    data = [packed(*(c[a:b] for c in columns)) for a, b in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(data), pa.int32()), pa.array(shard[cuts[:-1]].astype(np.int64)), pa.array(data, pa.binary())], names=["kind", "shard", "data"])


def own(**numbers) -> pa.RecordBatch:
    """A BLOCK row of a shard's numbers for the model."""
    data = json.dumps({k: np.asarray(v).tolist() for k, v in numbers.items()}).encode()
    return pa.RecordBatch.from_pydict({"kind": pa.array([OWN], pa.int32()), "shard": pa.array([0], pa.int64()), "data": pa.array([data], pa.binary())})


def by_shard(batches: Iterator[pa.RecordBatch], columns: dict[int, int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(kind, shard, its columns) from blocks sorted by kind and shard, where columns has the number of columns of a kind; a shard is a bounded part of the model. Blocks of other kinds come as they are, as bytes, under shard 0."""
    before, parts = None, []
    for batch in batches:
        for kind, s, data in zip(batch.column("kind").to_pylist(), batch.column("shard").to_pylist(), batch.column("data")):
            if parts and (kind, s) != before:
                yield *before, np.concatenate(parts, axis=1)
                parts = []
            if kind not in columns:
                yield kind, 0, data.as_py()
                continue
            before = kind, s
            parts.append(unpacked(data.as_py(), columns[kind]))
    if parts:
        yield *before, np.concatenate(parts, axis=1)


def local(uri: str) -> tuple[object, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, **arrays: np.ndarray) -> None:
    """The arrays in one file: whole or not at all, and the same again if the task is repeated."""
    import uuid

    files, path = local(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    head = json.dumps({k: [v.dtype.str, len(v)] for k, v in arrays.items()}).encode()
    part = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(f"{len(head):<8}".encode() + head.ljust(-(-len(head) // 8) * 8))
        for v in arrays.values():
            out.write(np.ascontiguousarray(v).tobytes() + bytes(-v.nbytes % 8))
    files.move(part, path)


def mapped(uri: str) -> dict[str, np.ndarray]:
    """A file's arrays, mapped; one in a remote store is copied to a file that goes with the mapping. None of a file that isn't there."""
    import os
    import tempfile

    from pyarrow import fs

    files, path = local(uri)
    if files.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    if isinstance(files, fs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with tempfile.NamedTemporaryFile(delete=False) as to, files.open_input_stream(path) as source:
            while data := source.read(1 << 24):
                to.write(data)
        try:
            raw = np.memmap(to.name, np.uint8, "r")
        finally:
            os.unlink(to.name)
    size = int(raw[:8].tobytes())
    at, out = 8 + -(-size // 8) * 8, {}
    for k, (kind, n) in json.loads(raw[8 : 8 + size].tobytes()).items():
        nbytes = np.dtype(kind).itemsize * n
        out[k] = raw[at : at + nbytes].view(kind)
        at += -(-nbytes // 8) * 8
    return out


def small(**columns: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of counts as bytes; 255 says that the number is in a list beside."""
    out = {}
    for k, v in columns.items():
        big = np.flatnonzero(v >= 255)
        out |= {k: np.minimum(v, 255).astype(np.uint8), f"{k}-at": big, f"{k}-big": v[big]}
    return out


def large(have: dict[str, np.ndarray], k: str, i: np.ndarray) -> np.ndarray:
    """Rows i of column k, as small() took it or plain."""
    out = have[k][i].astype(np.int64)
    if f"{k}-at" not in have:
        return out
    big = np.flatnonzero(out == 255)
    out[big] = have[f"{k}-big"][np.searchsorted(have[f"{k}-at"], i[big])]
    return out


class Model:
    """Where the tables are and the few numbers that go with them (one for each shard of words)."""

    def __init__(self, uri: str, bits: int, shard_tokens: int):
        self.uri, self.bits, self.shards = uri, bits, 1 << bits
        self.words = dict.fromkeys(range(self.shards), 0)  # shard -> number of words
        self.tokens = self.types = self.texts = 0
        #: Words seen more often are spread: as the only words of a context they would fill a shard.
        self.hot = max(64, shard_tokens // 8)
        self.discounts = {k: (0.0, 0.5, 1.0, 1.5) for k in (1, 2, 3)}
        self.frequent = np.empty(0, np.int64)  # ids
        self.pairs, self.rest = 0, 1.0  # distinct pairs; lower-order probability of a word never seen

    def offsets(self) -> np.ndarray:
        return np.array([0, *np.cumsum([self.words[s] for s in range(self.shards)])])

    @property
    def unseen(self) -> int:
        return self.types

    @property
    def begin(self) -> int:
        return self.types + 1

    def shard(self, context: np.ndarray, word: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """The shard of each n-gram, from its context's hash and its word: that of its context, or, where spread, of itself."""
        key = np.where(spread, mix(context, word), context)
        return (key >> U(64 - self.bits)).astype(np.int64)


class Lookup:
    """A worker's view of the model."""

    def __init__(self, model: Model):
        self.m, self.at = model, model.offsets()
        self.by_id = np.argsort(model.frequent, kind="stable")
        self.tables: dict[str, dict[str, np.ndarray]] = {}

    def table(self, name: str) -> dict[str, np.ndarray]:
        if name not in self.tables:
            self.tables[name] = mapped(f"{self.m.uri}/{name}")
        return self.tables[name]

    def each(self, name: str, shard: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray], np.ndarray]]:
        """(shard, its part of the table, the rows that ask it) of the shards that occur and that the table has."""
        order = np.argsort(shard.astype(np.uint16) if self.m.bits < 16 else shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.m.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            have = self.table(f"{name}-{s}")
            if have and len(next(iter(have.values()))):
                yield s, have, order[cuts[s] : cuts[s + 1]]

    def find(self, name: str, shard: np.ndarray, keys: np.ndarray, *columns: str, order: np.ndarray | None = None) -> list[np.ndarray]:
        """The columns of the table's rows with these keys; 0 where it has none. order sorts the keys."""
        out = [np.zeros(len(keys), np.int64) for _ in columns]
        # in the order of keys: a search for sorted keys passes over the array once
        order = np.argsort(keys) if order is None else order
        for _, have, rows in self.each(name, shard[order]):
            rows = order[rows]
            i = np.minimum(np.searchsorted(have["key"], keys[rows]), len(have["key"]) - 1)
            hit = have["key"][i] == keys[rows]
            for x, c in zip(out, columns):
                x[rows[hit]] = large(have, c, i[hit])
        return out

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Short numbers for frequent words, FREQUENT more than its id for each other."""
        out = ids + FREQUENT
        if len(self.by_id):
            have = self.m.frequent[self.by_id]
            i = np.minimum(np.searchsorted(have, ids), len(have) - 1)
            out = np.where(have[i] == ids, self.by_id[i], out)
        return out

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        out = codes - FREQUENT
        short = out < 0
        out[short] = self.m.frequent[codes[short]]
        return out

    def words(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids and counts of the words that occur, unseen and 0 for those that are none of training's, and each token's place among them."""
        keys, back = np.unique(tokens, return_inverse=True)
        ids, counts = np.full(len(keys), self.m.unseen, np.int64), np.zeros(len(keys), np.int64)
        for s, have, rows in self.each("words", keys >> (63 - self.m.bits)):
            i = np.minimum(np.searchsorted(have["key"], keys[rows]), len(have["key"]) - 1)
            hit = have["key"][i] == keys[rows]
            ids[rows[hit]], counts[rows[hit]] = self.at[s] + i[hit], large(have, "n", i[hit])
        return ids, counts, back

    def of_ids(self, name: str, column: str, ids: np.ndarray) -> np.ndarray:
        """A column that goes by word, of words with these ids; 0 of others."""
        out = np.zeros(len(ids), np.int64)
        for s, have, rows in self.each(name, np.clip(np.searchsorted(self.at, ids, side="right") - 1, 0, self.m.shards - 1)):
            known = ids[rows] < self.m.types
            out[rows[known]] = large(have, column, ids[rows[known]] - self.at[s])
        return out

    def hot(self, ids: np.ndarray) -> np.ndarray:
        n = np.where(ids == self.m.begin, self.m.texts, self.of_ids("words", "n", ids))
        return n > self.m.hot

    def level(self, k: int, contexts: np.ndarray, back: np.ndarray, word: np.ndarray, spread: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities of n-grams of order k, interpolated with the lower order's; contexts has each context's hash once, back its place there for each n-gram."""
        key = contexts[back]
        (n,) = self.find(f"grams-{k}", self.m.shard(key, word, spread), mix(key, word), "n")
        at, order = (contexts >> U(64 - self.m.bits)).astype(np.int64), np.argsort(contexts)
        (only,), whole, spread = (self.find(f"{kind}-{k}", at, contexts, *names, order=order) for kind, names in (("single", ("word",)), ("whole", CONTEXT), ("spread", CONTEXT)))
        total, n1, n2, n3 = (x + y for x, y in zip(whole, spread))  # a context is in one of the tables
        n, total, n1 = n + (only[back] == word + 1), total + (only > 0), n1 + (only > 0)
        d = np.array(self.m.discounts[k])
        backoff = np.where(total > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(total, 1), 1.0)
        return np.maximum(n - d[np.minimum(n, 3)], 0) / np.maximum(total, 1)[back] + backoff[back] * lower

    def texts(self, batches: Iterator[pa.RecordBatch], known: Hashes) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
        """(first row, its batch, hashes of tokens, tokens of each text) of runs of texts."""
        for batch in batches:
            for first, rows in chunks(batch.column("raw")):
                yield first, batch, *hashed(rows, known)

    def grams(self, tokens: np.ndarray, n: np.ndarray, coded: bool = False) -> tuple:
        """ids and counts of the words that occur, the start among them and, if coded, in the order of their codes; a key of each token's (a, b, c), as places among these words; and what makes places of keys."""
        ids, counts, back = self.words(tokens)
        ids, counts = np.concatenate([[self.m.begin], ids]), np.concatenate([[self.m.texts], counts])
        c, begin = back + 1, 0
        if coded:
            order = np.argsort(self.codes(ids))
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            ids, counts, c, begin = ids[order], counts[order], place[c], int(place[0])
        b = previous(c, n, begin)
        a = previous(b, n, begin)
        width = max(1, int(len(ids)).bit_length())
        mask = (1 << width) - 1
        if 3 * width < 64:
            return ids, counts, (((a << width) | b) << width) | c, lambda keys: (keys >> 2 * width, (keys >> width) & mask, keys & mask)
        pair, first = np.unique((a << width) | b, return_inverse=True)  # a text of over two million different words
        return ids, counts, (first << width) | c, lambda keys: (pair[keys >> width] >> width, pair[keys >> width] & mask, keys & mask)

    def score(self, tokens: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        m = self.m
        ids, counts, keys, places = self.grams(tokens, n)
        distinct, at = np.unique(keys, return_inverse=True)
        a, b, c = places(distinct)
        hot = counts > m.hot
        word = ids[c]
        ones = self.of_ids("ones", "n", ids)
        d = np.array(m.discounts[1])
        p = (np.maximum(ones - d[np.minimum(ones, 3)], 0) / max(m.pairs, 1) + m.rest)[c]
        p = self.level(2, mix(ids), b, word, hot[b], p)
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])  # n-grams are sorted, so those of a pair lie together
        p = self.level(3, mix(ids[a[new]], ids[b[new]]), np.cumsum(new) - 1, word, hot[a] & hot[b], p)
        starts, n_of = np.cumsum(n) - n, counts[c]
        base = np.log10((n_of + 0.5) / (m.tokens + 0.5 * (m.types + 1)))
        per_text = lambda v: np.add.reduceat(v[at], starts)
        return {"n_tokens": n, "n_known": per_text((n_of > 0).astype(np.int64)), "base_score": per_text(base), "score": per_text(np.log10(p))}


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney's, from the numbers of n-grams seen 1, 2, 3 and 4 times; the usual halves where too few are."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.01), float(k)) for k in (1, 2, 3))


def contexts(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """key, total, n1, n2, n3 of the contexts of n-grams with counts n."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    per = lambda x: np.add.reduceat(x.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    return key[start], per(n), per(n == 1), per(n == 2), per(n > 2)


def classes(n: np.ndarray) -> dict[str, int]:
    return {f"c{i}": int((n == i).sum()) for i in (1, 2, 3, 4)} | {"more": int((n > 2).sum()), "rows": len(n), "all": int(n.sum())}


def train(texts: DataFrame, uri: str | None = None, shard_tokens: int = TOKENS_A_SHARD) -> Model:
    """The model of column raw (UTF-8 bytes) of all rows of texts; null counts as empty.

    The number of shards goes by the bytes of text, at six a token. What comes
    to the driver is a few numbers for each shard.
    """
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    model = Model(uri or shared_dir(spark, "lm"), max(1, math.ceil(math.log2(max(1, size / 6 / shard_tokens)))), shard_tokens)
    bits, uri, shards = model.bits, model.uri, model.shards

    def gathered(rows: DataFrame) -> DataFrame:
        """The blocks of a shard in one task, in a row."""
        return rows.repartition(shards, "shard").sortWithinPartitions("kind", "shard")

    def numbers(told: DataFrame) -> list[dict]:
        return [json.loads(bytes(r.data)) for r in told.filter(F.col("kind") == OWN).collect()]

    def count_words(batches):
        known, parts, held = Hashes(), [], 0
        for batch in batches:
            for _, rows in chunks(batch.column("raw")):
                parts.append(np.unique(hashed(rows, known)[0], return_counts=True))
                held += len(parts[-1][0])
                if held >= RUN:
                    yield words_block(parts)
                    parts, held = [], 0
        if parts:
            yield words_block(parts)

    def words_block(parts):
        h, _, n = summed(np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts]))
        return blocks(LOWER, h >> (63 - bits), h, n)

    def write_words(batches):
        for _, s, (h, n) in by_shard(batches, {LOWER: 2}):
            h, _, n = summed(h, n)
            put(f"{uri}/words-{s}", key=h, **small(n=n))
            most = np.argsort(-n, kind="stable")[: -(-FREQUENT // shards)]
            yield own(shard=s, rows=len(h), total=n.sum(), ends=n[h == END].sum(), most=most, often=n[most])

    raw = texts.select("raw")
    words = numbers(gathered(raw.mapInArrow(count_words, BLOCK)).mapInArrow(write_words, BLOCK))
    for r in words:
        model.words[r["shard"]] = r["rows"]
        model.tokens, model.types, model.texts = model.tokens + r["total"], model.types + r["rows"], model.texts + r["ends"]
    at = model.offsets()
    most = sorted((-n, int(at[r["shard"]]) + i) for r in words for i, n in zip(r["most"], r["often"]))
    model.frequent = np.array([i for _, i in most[:FREQUENT]], np.int64)

    def count_grams(batches):
        known, look = Hashes(), Lookup(model)
        held, size = [], 0
        for _, _, tokens, n in look.texts(batches, known):
            held.append((tokens, n))
            size += len(tokens)
            if size >= RUN:
                yield grams_block(look, held)
                held, size = [], 0
        if held:
            yield grams_block(look, held)

    def grams_block(look: Lookup, held) -> pa.RecordBatch:
        ids, counts, keys, places = look.grams(*(np.concatenate(x) for x in zip(*held)), coded=True)
        distinct, n = np.unique(keys, return_counts=True)
        a, b, c = places(distinct)
        hot, code = counts > model.hot, look.codes(ids)
        return blocks(LOWER, model.shard(mix(ids[a], ids[b]), ids[c], hot[a] & hot[b]), code[a], code[b], code[c], n)

    def write_level(k: int, s: int, context: np.ndarray, word: np.ndarray, n: np.ndarray, spread: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Writes a shard's n-grams, with their contexts where they are whole here; gives numbers of the others."""
        yield own(**{f"{x}-{k}": v for x, v in classes(n).items()})
        order = np.argsort(context, kind="stable")
        context, word, n, spread = context[order], word[order], n[order], spread[order]
        edge = np.concatenate([[True], context[1:] != context[:-1], [True]])
        single = edge[1:] & edge[:-1] & (n == 1) & ~spread
        put(f"{uri}/single-{k}-{s}", key=context[single], word=word[single].astype(np.uint32 if model.types < 1 << 31 else np.int64) + 1)
        context, word, n, spread = context[~single], word[~single], n[~single], spread[~single]
        key, *told = contexts(context[~spread], n[~spread])
        put(f"{uri}/whole-{k}-{s}", key=key, **small(**dict(zip(CONTEXT, told))))
        gram = mix(context, word)
        order = np.argsort(gram)
        put(f"{uri}/grams-{k}-{s}", key=gram[order], **small(n=n[order]))
        if spread.any():
            part = contexts(context[spread], n[spread])
            yield blocks(SPREAD if k == 3 else SPREAD_LOWER, (part[0] >> U(64 - bits)).astype(np.int64), part[0].view(np.int64), *part[1:])

    def write_spread(k: int, s: int, key: np.ndarray, *n: np.ndarray) -> None:
        key, back = np.unique(key.view(U), return_inverse=True)
        put(f"{uri}/spread-{k}-{s}", key=key, **small(**dict(zip(CONTEXT, (np.bincount(back, x, len(key)).astype(np.int64) for x in n)))))

    def passed(kind: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([0], pa.int64()), pa.array([data], pa.binary())], names=["kind", "shard", "data"])

    def write_threes(batches):
        look = Lookup(model)
        for _, s, (a, b, c, n) in by_shard(batches, {LOWER: 4}):
            a, b, c = look.decoded(a), look.decoded(b), look.decoded(c)
            before = mix(a, b)
            _, first, n = summed(mix(before, c), n)
            a, b, c, before = a[first], b[first], c[first], before[first]
            firsts, back = np.unique(a, return_inverse=True)
            seconds, at = np.unique(b, return_inverse=True)
            hot = look.hot(seconds)[at]
            yield from write_level(3, s, before, c, n, hot & look.hot(firsts)[back])
            # at a text's start only the start itself precedes, so there the number of times counts
            key = mix(b)
            _, first, n = summed(mix(key, c), np.where(b == model.begin, n, 1))
            first, n, code = first[order := np.argsort(look.codes(b[first]), kind="stable")], n[order], look.codes(b[first[order]])
            yield blocks(LOWER, model.shard(key[first], c[first], hot[first]), code, look.codes(c[first]), n)

    def write_twos(batches):
        look = Lookup(model)
        for kind, s, x in by_shard(batches, {LOWER: 3, SPREAD: 5}):
            if kind == SPREAD:
                write_spread(3, s, *x)
            elif kind == OWN:
                yield passed(OWN, x)
            else:
                b, c, n = look.decoded(x[0]), look.decoded(x[1]), x[2]
                key = mix(b)
                _, first, n = summed(mix(key, c), n)
                b, c, key = b[first], c[first], key[first]
                words, back = np.unique(b, return_inverse=True)
                yield from write_level(2, s, key, c, n, look.hot(words)[back])
                c, n = np.unique(c, return_counts=True)
                yield blocks(LOWER, np.searchsorted(look.at, c, side="right") - 1, c, n)

    def write_ones(batches):
        at = model.offsets()
        for kind, s, x in by_shard(batches, {LOWER: 2, SPREAD_LOWER: 5}):
            if kind == SPREAD_LOWER:
                write_spread(2, s, *x)
            elif kind == OWN:
                yield passed(OWN, x)
            else:
                n = np.bincount(x[0] - at[s], x[1], model.words[s]).astype(np.int64)
                put(f"{uri}/ones-{s}", **small(n=n))
                yield own(**{f"{x}-1": v for x, v in classes(n).items()})

    # one job: each level's blocks go straight on to the next lower one's shards
    told = raw
    for step in (count_grams, write_threes, write_twos, write_ones):
        told = (told if step is count_grams else gathered(told)).mapInArrow(step, BLOCK)
    rows = numbers(told)
    total = lambda *names: [sum(r.get(x, 0) for r in rows) for x in names]
    for k in (3, 2, 1):
        model.discounts[k] = (0.0, *discounts(total(*(f"c{i}-{k}" for i in (1, 2, 3, 4)))))
    model.pairs, kinds, *c = total("all-1", "rows-1", "c1-1", "c2-1", "more-1")
    if model.pairs:
        model.rest = sum(d * n for d, n in zip(model.discounts[1][1:], c)) / model.pairs / (kinds + 1)
    return model


def lm_score(docs: DataFrame, model: Model) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score beside doc_id and held_out of docs, whose column raw is scored."""
    names = ["n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        known, look = Hashes(), Lookup(model)
        held, size = [], 0

        def scored() -> pa.RecordBatch:
            tokens, n = (np.concatenate(x) for x in zip(*(h[1:] for h in held)))
            out = look.score(tokens, n)
            keep = pa.Table.from_batches([h[0] for h in held]).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_pydict({x: keep.column(x) for x in ("doc_id", "held_out")} | {"train_tokens": pa.array([model.tokens] * len(n), pa.int64())} | {x: pa.array(out[x]) for x in names})

        for first, batch, tokens, n in look.texts(batches, known):
            held.append((batch.select(["doc_id", "held_out"]).slice(first, len(n)), tokens, n))
            size += len(tokens)
            if size >= RUN:
                yield scored()
                held, size = [], 0
        if held:
            yield scored()

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, train_tokens long, n_tokens long, n_known long, base_score double, score double")


def ngram_lm(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1) -> DataFrame:
    """Scores every row of docs by the model of those whose crc32(id) mod folds is not held.

    Null texts are empty: one token, the end. A null id counts as remainder 0,
    so it trains unless held is 0. Repeated rows count and are scored each by
    itself. With nothing to train on, every token has the probability of the
    one outcome there is. A text is held whole by one task. Other columns,
    whatever their names, play no part.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), (crc_mod(id_col, folds) == held).alias("held_out"), F.encode(F.col(text_col), "UTF-8").alias("raw"))
    return lm_score(df, train(df.filter(~F.col("held_out"))))


@query
def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm(table(spark, sf_dir, "documents"))
