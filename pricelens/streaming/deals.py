"""Ingestion as a stream: each variant's recent deals as state, every change told, and what was told before taken back."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.operators.fold import WINDOW_S
from pricelens.operators.ingest import DEAL, POST, Fold, absorb, begun, columns_of

#: op: RETRACT (a row told before, as it was) or ASSERT (as it is); taken: the posts that made the change.
CHANGE = f"op string, {DEAL}, taken array<string>"
SETS = ("sites", "candidates", "conditions")
#: What a group is sent of its posts; all are of its variant, so candidates don't count.
SENT = [c for c in POST if c not in ("variant_id", "candidates")]


def stored(deals: list[dict]) -> bytes:
    """deals as packed JSON: most of it are numbers of posts, which are much alike."""
    return zlib.compress(json.dumps([{k: sorted(v) if k in SETS else v for k, v in d.items()} for d in deals]).encode(), 1)


def restored(packed: bytes) -> list[dict]:
    return [{k: set(v) if k in SETS else [tuple(m) for m in v] if k == "moves" else v for k, v in d.items()} for d in json.loads(zlib.decompress(packed))]


def deal_changes(posts: DataFrame, late_s: int = 7 * 86400) -> DataFrame:
    """CHANGE rows of a stream of POST rows of known variants: for each deal that a micro-batch changed, what was told of it and what holds now.

    State is a variant's deals that a post of the last late_s seconds before
    its newest can still join: those begun within the window before that; with
    the numbers of their posts, so a post that comes again is no post. Nothing
    is dropped for being late, and a post that moves a deal's first sighting
    back retracts what was told. If posts come in the order of their numbers
    and none is more than late_s behind its variant's newest, the deals are
    fold_posts()'s, however the log is cut; posts in another order make the
    deals of the order in which they came, and one that is later still begins
    a deal where the deal that it would have joined is no longer held. Posts
    without a variant go to review and make no deals here.
    """
    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # columns to plain lists once; a dictionary for each post, not a frame's row
        lists = [[] for _ in SENT]
        for frame in frames:
            for values, name in zip(lists, SENT):
                values += frame[name].tolist()
        newest, held = (state.get[0], restored(state.get[1])) if state.exists else (0, [])
        fold, known, was, taken = Fold(held), {i for d in held for i in d["post_ids"]}, {}, {}
        n = len(fold.deals)
        for values in sorted(zip(*lists), key=lambda r: r[0]):
            post = dict(zip(SENT, values), variant_id=key[0], candidates=())
            if post["post_id"] in known:
                continue
            known.add(post["post_id"])
            tags = post["conditions"]
            post["conditions"] = () if tags is None else [x for x in tags if x is not None]
            met = fold.cells.near(int(post["price"]), int(post["seen"]))  # all deals here are of the post's variant
            if met:
                at = met[0]
                d = fold.deals[at]
                if at < n and at not in taken:  # what was told of it, before it changes
                    was[at] = dict(d, **{c: set(d[c]) for c in SETS}, moves=list(d["moves"]))
                absorb(d, post)
                fold.put(d, at)
            else:
                at = fold.put(dict(begun(post), post_ids=[]))
            fold.deals[at]["post_ids"].append(post["post_id"])
            taken.setdefault(at, []).append(post["post_id"])
        told = [(op, d, taken[at]) for at in sorted(taken) for op, d in (("RETRACT", was.get(at)), ("ASSERT", fold.deals[at])) if d is not None]
        newest = max(newest, *map(int, lists[SENT.index("seen")]))
        state.update((newest, stored([d for d in fold.deals if d["first_seen"] >= newest - WINDOW_S - late_s])))
        if told:
            yield pd.DataFrame({"op": [op for op, _, _ in told], **columns_of([d for _, d, _ in told]), "taken": [t for _, _, t in told]})

    known = posts.filter("variant_id IS NOT NULL").select(F.col("variant_id").cast("string").alias("variant_id"), *SENT)
    return known.groupBy("variant_id").applyInPandasWithState(run, CHANGE, "newest long, deals binary", "update", "NoTimeout")


def write_changes(changes: DataFrame, path: str, checkpoint: str):
    """A writer of changes that puts each micro-batch in a folder of its own; one that comes again after a failure replaces what it had written."""
    return changes.writeStream.outputMode("update").foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")).option("checkpointLocation", checkpoint)


def deals_told(spark: SparkSession, path: str) -> DataFrame:
    """DEAL rows as the changes below path leave them: the last of each deal."""
    log = spark.read.schema(CHANGE + ", batch long").parquet(path).filter("op = 'ASSERT'")
    last = Window.partitionBy("deal_id").orderBy(F.desc("batch"))
    return log.withColumn("k", F.row_number().over(last)).filter("k = 1").select(*[c.split()[0] for c in DEAL.split(", ")])
