"""Rate limits by blocks of time against one counter that sees every event."""

import random

import pytest

from pricelens.operators import limits


def replay(events, limit, window):
    out = {}
    for key, at in sorted((e for e in events if e[1] is not None), key=lambda e: (e[0] is not None, e[0] or 0, e[1])):
        start, used, yes, no = out.get(key, (None, 0, 0, 0))
        if start is None or at - start >= window:
            start, used = at, 0
        out[key] = (start, used + 1, yes + 1, no) if used < limit else (start, used, yes, no + 1)
    return {k: (yes, no) for k, (_, _, yes, no) in out.items()}


@pytest.mark.parametrize("block,batch", [(64, 10_000), (1, 7), (3, 50)])
def test_windows_as_one_counter_has_them(spark, monkeypatch, block, batch):
    monkeypatch.setattr(limits, "BLOCK", block)
    rng = random.Random(block)
    events = [(k, rng.choice([rng.randrange(-20_000, 20_000), rng.randrange(300), 5])) for k in (None, 1, 2, 3) for _ in range(400)] + [(9, 100), (9, None), (8, None)] + [(4, 100 * i) for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {r.key: (r.accepted, r.rejected) for r in limits.rate_limited(spark.createDataFrame(events, "key long, at long").repartition(3), 2, 100).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == replay(events, 2, 100)
    assert limits.rate_limited(spark.createDataFrame([], "key string, at long"), 2, 100).collect() == []


def test_one_key_of_many_events_is_no_row(spark):
    """All of 600,000 events are one key's: blocks of them are dealt over tasks."""
    df = spark.range(600_000).selectExpr("'hot' AS key", "(id * 7919) % 600000 * 37 AS at")
    (r,) = limits.rate_limited(df, 3, 1000).collect()
    want = replay([("hot", i * 37) for i in range(600_000)], 3, 1000)
    assert (r.accepted, r.rejected) == want["hot"]


def test_no_key_is_split_where_a_join_is_broadcast_as_it_runs(spark):
    """A sort-merge join that turns out small reads its shuffles locally, by the task that wrote them: each window is counted once, whole."""
    df = spark.range(40_000).selectExpr("id % 5 AS key", "id * 7919 % 100003 AS at").repartition(8)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10k"}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        out = limits.rate_limited(df, 50, 1000)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.key: (r.accepted, r.rejected) for r in out.collect()}
    finally:
        for name in conf:
            spark.conf.unset(name)
    assert got == replay([(r.key, r.at) for r in df.collect()], 50, 1000)
