"""Streams against their batch operators, on any cut of the log, and started again from their checkpoint."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricelens.operators import ingest, polls
from pricelens.plans import stream_queries
from pricelens.streaming import deals
from pricelens.streaming.polls import drift_stream, health_stream
from tests.test_ingest import SCHEMA, plain, posts, told

NOW = dt.datetime(2026, 7, 15)


def written(spark, rows, schema, path, cuts):
    """rows as one file for each stretch between cuts, in the order of their names and times."""
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}") if b > a else None


def read(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def run(writer):
    q = writer.trigger(availableNow=True).start()
    assert q.awaitTermination(300)


def kept(changes, path, checkpoint, mode):
    run(changes.writeStream.outputMode(mode).foreachBatch(lambda df, b: df.write.mode("overwrite").parquet(f"{path}/batch={b}")).option("checkpointLocation", checkpoint))


@pytest.mark.parametrize("cuts", [[], [7, 8, 150], [100, 200]])
def test_deals_on_any_cut_are_the_batch_folds(spark, tmp_path, cuts):
    rows = posts(260, 5, variants=("a", "b", "c", None))
    written(spark, rows, SCHEMA, f"{tmp_path}/log", cuts)
    changes = deals.deal_changes(read(spark, SCHEMA, f"{tmp_path}/log"), late_s=30 * 86_400)
    run(deals.write_changes(changes, f"{tmp_path}/out", f"{tmp_path}/cp"))
    want = ingest.fold_posts(spark.createDataFrame([r for r in rows if r[1] is not None], SCHEMA))
    assert told(deals.deals_told(spark, f"{tmp_path}/out")) == told(want)


def test_started_again_nothing_counts_twice_and_late_posts_take_back(spark, tmp_path):
    rows = posts(200, 6, variants=("a", "b"))
    shuffled = random.Random(3).sample(rows, len(rows))
    start = lambda: run(deals.write_changes(deals.deal_changes(read(spark, SCHEMA, f"{tmp_path}/log"), late_s=30 * 86_400), f"{tmp_path}/out", f"{tmp_path}/cp"))
    written(spark, shuffled[:90], SCHEMA, f"{tmp_path}/log", [30])
    start()
    # new posts and some of those before once more, in another run of the query
    written(spark, shuffled[90:] + shuffled[:40], SCHEMA, f"{tmp_path}/log/more", [60])
    start()
    # the deals are those of the order in which the posts came: by micro-batch, then number
    order = sorted(shuffled[:30]) + sorted(shuffled[30:90]) + sorted(shuffled[90:150]) + sorted(shuffled[150:])
    assert told(deals.deals_told(spark, f"{tmp_path}/out")) == plain(order)
    log = spark.read.parquet(f"{tmp_path}/out").collect()
    held = {}
    for r in sorted(log, key=lambda r: (r.batch, r.op == "ASSERT")):
        now = tuple(r)[1:-2]
        if r.op == "RETRACT":
            assert held.pop(r.deal_id) == now  # just what was told before
        else:
            assert r.deal_id not in held
            held[r.deal_id] = now
    moved = [r for r in log if r.op == "RETRACT" and any(a.op == "ASSERT" and a.deal_id == r.deal_id and a.batch == r.batch and a.first_seen < r.first_seen for a in log)]
    assert len(held) == len(plain(order)) and moved
    assert sorted(i for r in log if r.op == "ASSERT" for i in r.taken) == sorted(r[0] for r in rows)


def test_old_deals_leave_the_state_and_no_late_post_is_lost(spark, tmp_path):
    day = 86_400
    post = lambda i, at: (f"p{i}", "a", [], 50_000, at, "x", "u", "LIVE", "ACTIVE", False, [], None, "")
    rows = [post(1, 0), post(2, 20 * day), post(3, 1 * day), post(4, 19 * day)]
    written(spark, rows, SCHEMA, f"{tmp_path}/log", [1, 2, 3])
    run(deals.write_changes(deals.deal_changes(read(spark, SCHEMA, f"{tmp_path}/log"), late_s=2 * day), f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = {r.deal_id: r.posts for r in deals.deals_told(spark, f"{tmp_path}/out").collect()}
    assert got == {"p1": 1, "p2": 2, "p3": 1}  # the third came when the first was no longer held


@pytest.mark.parametrize("cuts", [[], [1, 2, 3], [50, 200, 201]])
def test_drift_and_health_on_any_cut(spark, tmp_path, cuts):
    rng = random.Random(len(cuts))
    rows = [(f"s{i % 3}", i, NOW + dt.timedelta(minutes=i), rng.choices(["OK", "TRANSIENT", "BLOCKED"], [7, 3 + 4 * (i % 100 > 60), 0.5])[0], rng.choice([0, 0, 3, 5]), rng.choice([0, 2])) for i in range(400)]
    schema = "site string, event_id long, seen_at timestamp, outcome string, deal_count long, priced_count long"
    written(spark, rows, schema, f"{tmp_path}/polls", cuts)
    kept(drift_stream(read(spark, schema, f"{tmp_path}/polls")), f"{tmp_path}/alerts", f"{tmp_path}/cp1", "append")
    want = sorted(map(tuple, polls.drift(spark.createDataFrame(rows, schema)).select("site", "event_id", "reason").collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/alerts").select("site", "event_id", "reason").collect())) == want and {r for _, _, r in want} == {"EMPTY", "PRICELESS", "UNSTABLE"}
    checks = [(f"c{i % 2}", i, NOW + dt.timedelta(minutes=i), rng.random() < 0.4) for i in range(300)]
    schema = "component string, check_id long, seen_at timestamp, ok boolean"
    written(spark, checks, schema, f"{tmp_path}/checks", cuts)
    kept(health_stream(read(spark, schema, f"{tmp_path}/checks")), f"{tmp_path}/alarms", f"{tmp_path}/cp2", "append")
    want = sorted(map(tuple, polls.health_alarms(spark.createDataFrame(checks, schema)).collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/alarms").select("component", "check_id").collect())) == want and len(want) > 5


def test_many_tasks_write_a_stretch_and_it_is_one_micro_batch(spark, tmp_path):
    """The log of a query is not written by one task, and the stream takes each of its stretches whole, in their order."""
    rows = posts(300, 8, variants=("a", "b", "c"))
    df = spark.createDataFrame(rows, SCHEMA).select(*ingest.POST)
    out = f"{tmp_path}/out"
    stream_queries.streamed(df.repartition(4), f"{tmp_path}/log", F.col("post_id"), ["p00100", "p00200"], lambda log: deals.write_changes(deals.deal_changes(log, late_s=30 * 86_400), out, f"{tmp_path}/cp"))
    assert len(list(tmp_path.glob("log/*.parquet"))) == 12
    taken = spark.read.parquet(out).filter("op = 'ASSERT'").select("batch", F.explode("taken").alias("post_id")).groupBy("batch").agg(F.min("post_id"), F.max("post_id"), F.count("*")).collect()
    assert sorted(map(tuple, taken)) == [(0, "p00000", "p00099", 100), (1, "p00100", "p00199", 100), (2, "p00200", "p00299", 100)]
    assert told(deals.deals_told(spark, out)) == plain(rows)


def test_what_is_held_is_packed():
    held = [dict(ingest.begun(dict(zip(ingest.POST, r[:12]), post_id=r[0], variant_id="a", candidates=(), price=r[3], seen=r[4], site=r[5], url=r[6], origin=r[7], status=r[8], excluded=r[9], conditions=r[10] or (), demand_axis_value=r[11])), post_ids=[f"{r[0]}-{k}-200-300" for k in range(60)]) for r in posts(50, 1)]
    packed = deals.stored(held)
    assert deals.restored(packed) == held and len(packed) * 4 < sum(len(i) for d in held for i in d["post_ids"])
