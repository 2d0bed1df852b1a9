"""Cost-balanced packing of tokenised documents into sequences of fixed length.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n. Within a shard - the
documents that a task reads one after another, some megabytes - pieces go,
dearest first, to the sequence of lowest cost that has room. A shard has as many
sequences as its tokens fill; a piece that fits nowhere whole is cut, and what
is left over goes on to the next shard. At a task's end what is left fills
powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table

LENGTH, END_ID = 2048, 1
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH
#: Bytes of text that make a shard; a longer document is a shard by itself.
SHARD = 4_000_000
#: Longer texts are encoded in parts of this many characters.
LONG = 200_000
#: Fixed value: how byte-level BPE of this kind splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A place where tokens end whatever stands around it: no token has a space after a letter, and nothing before a place that a letter ends hangs on what follows it.
CUT = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")


class Encoder:
    """ids of a text by the vocabulary file at path (tokenizers' JSON, byte-level BPE), special tokens in texts included.

    tiktoken applies the same merges - here a merge's rank is its id - at a few
    times the speed; the tests hold both against each other.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]  # these bytes stand for themselves, the others for 256, 257, ...
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)

    def encode(self, text: str) -> np.ndarray:
        ids: list[int] = []
        at = 0
        while at < len(text) or not at:
            cut = CUT.search(text, at + LONG) if len(text) - at > LONG else None
            end = cut.start() if cut else len(text)
            ids += self.fast.encode(text[at:end], allowed_special=self.special, disallowed_special=())
            at = end or 1
        return np.array([*ids, END_ID], "<u4")


def capacities(tokens: int, length: int, last: bool) -> np.ndarray:
    """Whole sequences; at the end also powers of two for what is left."""
    rest = tokens % length if last else 0
    return np.array([length] * (tokens // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def assign(pieces: list[tuple[int, int, int]], length: int, last: bool) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Of pieces (document, start, tokens): (document, start, tokens, sequence, offset) of what fills sequences to the last token, and the pieces left."""
    room = capacities(sum(p[2] for p in pieces), length, last)
    used, cost = np.zeros_like(room), np.zeros(len(room))
    cut = [(d, a + k, min(length, n - k)) for d, a, n in pieces for k in range(0, n, length)]
    out, left = [], []
    for d, a, n in sorted(cut, key=lambda p: (-p[2], p[0], p[1])):  # cost grows with length
        while n:
            fits = np.flatnonzero(room >= n)
            at = fits if len(fits) else np.flatnonzero(room)
            if not len(at):
                left.append((d, a, n))
                break
            s = int(at[cost[at].argmin()])
            k = min(n, int(room[s]))
            out.append((d, a, k, s, int(used[s])))
            used[s] += k
            room[s] -= k
            cost[s] += LINEAR * k + QUADRATIC * k * k
            n, a = n - k, a + k
    return out, left


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset: a row for each piece.

    A null or empty text is the end id alone; a null id stays null; repeated
    rows are documents of their own; an empty table gives no pieces; other
    columns, whatever their names, play no part. Documents are packed where
    they are read: no shuffle, and a repeated task packs alike. Equally long
    pieces go in the order they are read, equally cheap sequences are taken in
    their order. A document is held whole by one task. sequence_id is the partition's number times 2**32 plus a count.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = Encoder(tokenizer), TaskContext.get().partitionId() << 32
        docs: dict[int, tuple] = {}  # document's number in the task -> its id, its ids
        pieces: list[tuple[int, int, int]] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal docs, pieces, sequence
            rows, pieces = assign(pieces, length, last)
            if rows:
                cols = [pa.array([docs[d][0] for d, *_ in rows], kind), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))]
                cols += [pa.array([docs[d][1][a : a + k].tobytes() for d, a, k, _, _ in rows], pa.binary()), pa.array([len(docs[d][1]) for d, *_ in rows], pa.int64())]
                cols += [pa.array([r[3] + sequence for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                sequence += max(r[3] for r in rows) + 1
            docs = {d: docs[d] for d, *_ in pieces}

        kind, n, size = None, 0, 0
        for batch in batches:
            kind = batch.column("doc_id").type
            for id_, text in zip(batch.column("doc_id"), batch.column("text")):
                text = text.as_py() or ""
                docs[n] = (id_.as_py(), encoder.encode(text))
                pieces.append((n, 0, len(docs[n][1])))
                n, size = n + 1, size + len(text)
                if size >= SHARD:
                    yield from flush(False)
                    size = 0
        if pieces:
            yield from flush(True)

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pack(table(spark, sf_dir, "documents"), public_tokenizer())
    return df.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
