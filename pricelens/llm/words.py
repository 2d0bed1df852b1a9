"""Words of UTF-8 texts and their hashes, in workers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of text that a worker handles at once.
CHUNK = 1_000_000
#: Most words a worker remembers the hash of.
REMEMBERED = 150_000


def hash63(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) >> 1


class Hashes(dict):
    """word -> hash63 of it."""

    def __init__(self):
        from xxhash import xxh64_intdigest

        self.digest = xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = self.digest(word) >> 1
        return h


def chunks(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of each text) for runs of rows of about CHUNK bytes. Bytes' lower() and split() know ASCII only."""
    rows, size, first = [], 0, 0
    for i, raw in enumerate(column):
        raw = raw.as_py() or b""
        rows.append(raw.lower().split())
        size += len(raw)
        if size >= CHUNK:
            yield first, rows
            rows, size, first = [], 0, i + 1
    if rows:
        yield first, rows
