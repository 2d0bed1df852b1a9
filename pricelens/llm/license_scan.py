"""License scans: fuzzy search for short notices in word-normalised text.

A notice of n characters may differ in k edits. Cut into k + 1 pieces, at least
one piece of every such match stands unchanged (pigeonhole), so an exact search
for the pieces finds all candidates; the regex library then holds every run of
whole words around each against the notice, with at most k errors, and counts
its edits. Of runs that overlap the best is reported.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table

#: Fixed values of the result's contract: phrases that count where their words stand consecutively.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices searched with errors, unless others are given: text, label, words that must stand unchanged in the match.
NOTICES = (
    ("under the mit license", "mit", ("mit",)),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", ()),
    ("spdx license identifier mit", "mit", ("mit",)),
    ("under the apache license version 2", "apache-2", ("2",)),
    ("spdx license identifier apache 2", "apache-2", ("apache", "2")),
    ("licensed under cc by nc", "cc-by-nc", ("cc", "nc")),
    ("creative commons attribution noncommercial", "cc-by-nc", ()),
    ("creative commons attribution sharealike", "cc-by-sa", ()),
    ("creative commons zero", "cc0", ("zero",)),
    ("no rights reserved creative commons", "cc0", ("no",)),
    ("gnu general public license", "gpl", ("gnu",)),
    ("gnu lesser general public license", "lgpl", ("gnu",)),
    ("gnu affero general public license", "agpl", ("gnu",)),
    ("gnu free documentation license", "gfdl", ("gnu",)),
    ("redistribution and use in source and binary forms", "bsd", ()),
    ("under the bsd 3 clause license", "bsd", ("bsd", "3")),
    ("under the bsd 2 clause license", "bsd", ("bsd", "2")),
    ("mozilla public license version 2", "mpl-2", ("2",)),
    ("eclipse public license", "epl", ()),
    ("common development and distribution license", "cddl", ()),
    ("boost software license version 1", "bsl-1", ("1",)),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", ()),
    ("this is free and unencumbered software released into the public domain", "unlicense", ()),
    ("artistic license 2", "artistic-2", ("2",)),
    ("european union public licence", "eupl", ()),
    ("sil open font license", "ofl", ("sil",)),
    ("server side public license", "sspl", ()),
    ("business source license", "busl", ()),
    ("python software foundation license", "psf", ()),
)
CHARS_PER_EDIT, MOST_EDITS = 10, 3
RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>"
#: Maps upper case to lower and every other ASCII byte that isn't in a word to a space.
FOLD = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def pieces(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """(offset, text) of edits + 1 pieces that make up the notice."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def places(text: bytes, what: bytes) -> Iterator[int]:
    at = text.find(what)
    while at >= 0:
        yield at
        at = text.find(what, at + 1)


def blanks(text: bytes) -> np.ndarray:
    """Where the spaces are: a word's number is that of the space before it."""
    return np.flatnonzero(np.frombuffer(text, np.uint8) == 32)


class Scanner:
    def __init__(self, notices=NOTICES):
        import regex

        self.notices = []
        for text, label, needed in notices:
            raw = text.encode()
            k = max(1, min(MOST_EDITS, len(raw) // CHARS_PER_EDIT))
            # (?b): the fewest errors that make the two alike
            pattern = regex.compile(rb"(?b)(?:" + regex.escape(raw, special_only=True) + rb"){e<=%d}" % k)
            self.notices.append((raw, label, {x.encode() for x in needed}, k, pattern, pieces(raw, k)))

    def verified(self, text: bytes, notice: bytes, needed: set[bytes], k: int, pattern, seeds) -> list[tuple[int, int, int]]:
        """(edits, start, end) of every run of whole words around a seed that is the notice in at most k edits and has the words needed."""
        starts = set()
        for off, seed in seeds:
            for at in places(text, seed):
                before, last = max(0, at - off - k - 1), max(0, at - off + k)
                while (before := text.find(b" ", before, last)) >= 0:
                    before += 1
                    starts.add(before)
        found = []
        for a in starts:
            end, last = a + max(1, len(notice) - k) - 1, a + len(notice) + k
            while (end := text.find(b" ", end + 1, last + 1)) >= 0:
                if needed <= set(text[a:end].split()) and (m := pattern.fullmatch(text, a, end, concurrent=False)):
                    found.append((sum(m.fuzzy_counts), a, end))
        return found

    def fuzzy(self, text: bytes, spaces: np.ndarray | None = None) -> list[tuple[str, int, int, int]]:
        """(label, first word, last word, edits) of the notices in a folded text: of verified runs that overlap, the one of fewest edits (the first of several) stands."""
        found = []
        spaces = blanks(text) if spaces is None else spaces
        for notice, label, needed, k, pattern, seeds in self.notices:
            taken: list[tuple[int, int]] = []
            for edits, a, b in sorted(self.verified(text, notice, needed, k, pattern, seeds)):
                i = bisect.bisect(taken, (a, b))
                if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b):
                    continue
                taken.insert(i, (a, b))
                first, last = np.searchsorted(spaces, (a, b)).tolist()
                found.append((label, first - 1, last - 1, edits))
        return found

    def scan(self, raw: bytes | None) -> dict:
        words = (raw or b"").translate(FOLD).split()
        text = b" " + b" ".join(words) + b" "
        spaces = blanks(text)
        base = [(int(np.searchsorted(spaces, at)), label) for phrase, label in BASE.items() for at in places(text, b" %s " % phrase.encode())]
        spans = self.fuzzy(text, spaces)
        starts, labels = [x[0] for x in base], {x[1] for x in base}
        lengths = {label: max(len(n[0]) for n in self.notices if n[1] == label) for label in {x[0] for x in spans}}
        score = 1.0 if base else max((1 - e / lengths[label] for label, _, _, e in spans), default=0.0)
        return {
            "n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {x[0] for x in spans})), "score": score,
            "spans": [dict(zip(("label", "first_word", "last_word", "edits"), x)) for x in sorted(spans, key=lambda x: (x[1], x[0]))],
        }


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Sequence[tuple[str, str, tuple[str, ...]]] = NOTICES) -> DataFrame:
    """One row per row of docs: its id and RESULT. notices are texts in lower-case words, their labels, and words needed unchanged.

    Null and empty texts have no words and no labels; a null id stays null;
    repeated rows are scanned each by itself; an empty table gives none; other
    columns of docs, whatever their names, play no part. Of runs that overlap
    and have as many edits the first stands. A text is held whole, one at a time; batches
    are bounded by Spark's Arrow batch size. No shuffle.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, schema = Scanner(notices), None
        for batch in batches:
            rows = [scanner.scan(x) for x in batch.column("raw").to_pylist()]
            schema = schema or pa.schema([
                ("doc_id", batch.schema.field("doc_id").type), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))),
            ])
            cols = [batch.column("doc_id"), *(pa.array([r[f.name] for r in rows], f.type) for f in list(schema)[1:])]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {RESULT}")


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")
