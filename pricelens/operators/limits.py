"""Rate limits of keys with any number of events: no key is one row, and a key's log is cut by time.

Windows follow one another: each begins at the first event behind the last
one's end, so where one begins hangs on all before it. But within a block of
time few events can be the first that begins a window - those of its first
window's length, and the next - and for each of them it is known where the
block's last window begins. One pass over these, a few a block, tells where the
first window of each block begins; with that each block is counted by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows' lengths in a block.
BLOCK = 64


def groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each key and block, whole, of frames that come sorted by these."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        k, b = frame["k"].to_numpy(), frame["block"].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(frame)]
        for a, z in zip(cuts, cuts[1:]):
            part = frame.iloc[a:z]
            if held and (held[0]["k"].iat[0], held[0]["block"].iat[0]) != (part["k"].iat[0], part["block"].iat[0]):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def beginnings(window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each event that can begin a block's first window: where the block's last window begins then."""
        for g in groups(frames):
            t = g["at"].to_numpy()
            block = int(g["block"].iat[0])
            after = np.searchsorted(t, t + window)
            last = np.arange(len(t))
            for i in range(len(t) - 1, -1, -1):
                if after[i] < len(t):
                    last[i] = last[after[i]]
            n = min(len(t), int(np.searchsorted(t, block * BLOCK * window + window)) + 1)
            yield pd.DataFrame({"k": g["k"].iat[0], "block": block, "at": t[:n], "last": t[last[:n]]})

    return run


def chained(window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Where each block's first window begins (null if none does), and the window open before it; one key's open window is carried on."""
        key, block, open_, since, begins = None, None, None, None, None
        for f in frames:
            out = []
            for k, b, at, last in zip(f["k"], f["block"], f["at"], f["last"]):
                if (k, b) != (key, block):
                    if key is not None:
                        out.append((key, block, begins, since))
                    open_ = open_ if k == key else None
                    key, block, since, begins = k, b, open_, None
                if begins is None and (since is None or at >= since + window):
                    begins, open_ = at, last
            yield pd.DataFrame(out, columns=["k", "block", "begins", "since"]).astype({"block": "Int64", "begins": "Int64", "since": "Int64"})
        if key is not None:
            yield pd.DataFrame([(key, block, begins, since)], columns=["k", "block", "begins", "since"]).astype({"block": "Int64", "begins": "Int64", "since": "Int64"})

    return run


def counted(window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How many of a block's events (what 2) each window holds; before them come the window open before the block (0) and the start of the first within it (1), where there are such."""
        for g in groups(frames):
            what, at = g["what"].to_numpy(), g["at"].to_numpy()
            t, since, begins = at[what == 2], at[what == 0], at[what == 1]
            a = int(np.searchsorted(t, begins[0])) if len(begins) else len(t)
            rows = [(int(since[0]), a)] if a else []
            while a < len(t):
                z = int(np.searchsorted(t, t[a] + window))
                rows.append((int(t[a]), z - a))
                a = z
            yield pd.DataFrame({"k": g["k"].iat[0], "start": [s for s, _ in rows], "n": [n for _, n in rows]})

    return run


def rate_limited(events: DataFrame, limit: int, window_us: int) -> DataFrame:
    """key, accepted, rejected of events (key, at in microseconds) under windows that begin at the first event at or after the last window's end and take limit events each.

    A null key is a key, events without a time are left out. A task holds the
    times of one key in one block of BLOCK windows, 8 bytes each.
    """
    kind = events.schema["key"].dataType
    k = F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("-"))
    df = events.filter(F.col("at").isNotNull()).select(k.alias("k"), F.floor(F.col("at") / F.lit(BLOCK * window_us)).cast("long").alias("block"), F.col("at").cast("long").alias("at"))
    dealt = df.repartition("k", "block").sortWithinPartitions("k", "block", "at")
    first = dealt.mapInPandas(beginnings(window_us), "k string, block long, at long, last long")
    starts = first.repartition("k").sortWithinPartitions("k", "block", "at").mapInPandas(chained(window_us), "k string, block long, begins long, since long")
    # a union, not a join by the same columns: that would stand for the repartition, and where it is broadcast as it runs its rows stay with the tasks that wrote them
    told = starts.select("k", "block", F.inline(F.array(F.struct(F.lit(0).alias("what"), F.col("since").alias("at")), F.struct(F.lit(1).alias("what"), F.col("begins").alias("at"))))).filter("at IS NOT NULL")
    rows = df.select("k", "block", F.lit(2).alias("what"), "at").unionByName(told)
    parts = rows.repartition("k", "block").sortWithinPartitions("k", "block", "what", "at").mapInPandas(counted(window_us), "k string, start long, n long")
    windows = parts.groupBy("k", "start").agg(F.sum("n").alias("n"))
    out = windows.groupBy("k").agg(F.sum(F.least("n", F.lit(limit))).alias("accepted"), F.sum("n").alias("n"))
    key = F.when(F.col("k") != "-", F.expr("substring(k, 2)")).cast(kind)
    return out.select(key.alias("key"), "accepted", (F.col("n") - F.col("accepted")).alias("rejected"))
