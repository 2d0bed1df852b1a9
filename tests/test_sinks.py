"""Keyed tables and tables that only grow, under batches that come again."""

import datetime as dt
import os

from pricelens.streaming import sinks

T = dt.datetime(2026, 7, 1)
POST = "site string, post_id long, title string, posted_at timestamp, origin string, captured_at long, part int"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_posts_merge_and_a_batch_again_changes_nothing(spark, tmp_path):
    table = sinks.raw_posts(f"{tmp_path}/posts")
    first = [("x", i, f"t{i}", None if i % 2 else T, "LIVE", 1, i // 100) for i in range(1000)]
    table.merge(spark.createDataFrame(first, POST), 0)
    before = files(f"{tmp_path}/posts")
    # ten keys in a hundred of one part, one of them twice, and a new one in a part of its own
    later = T + dt.timedelta(days=1)
    second = [("x", 300 + i, "new", later, "BACKFILL", 2, 3) for i in range(10)] + [("x", 305, "newest", None, "BACKFILL", 3, 3), ("y", 5000, "first", None, "BACKFILL", 2, 50)]
    table.merge(spark.createDataFrame(second, POST), 1)
    after = files(f"{tmp_path}/posts")
    assert {f for f in before if "part=3/" not in f} <= {f for f, t in after.items() if before.get(f) == t}
    rows = lambda: {(r.site, r.post_id): (r.title, r.posted_at, r.origin) for r in table.rows(spark).collect()}
    want = {("x", i): (t, p, o) for _, i, t, p, o, _, _ in first} | {("x", 300 + i): ("new", later if i % 2 else T, "LIVE") for i in range(10)} | {("x", 305): ("newest", None, "LIVE"), ("y", 5000): ("first", None, "BACKFILL")}
    assert rows() == want
    table.merge(spark.createDataFrame(second, POST), 1)
    assert rows() == want
    table.merge(spark.createDataFrame(first[:50], POST), 0)  # older than what stands in none of its rows: as it was
    assert rows() == want
    table.merge(spark.createDataFrame(first[300:310], POST), 0)  # older than what stands
    assert rows() == want
    table.merge(spark.createDataFrame([], POST), 2)
    assert rows() == want


def test_cursors_never_lose_a_success(spark, tmp_path):
    table = sinks.poll_states(f"{tmp_path}/state")
    schema = "site string, last_successful_poll_at timestamp, consecutive_failures int, updated_at long, part int"
    for n, (at, failures) in enumerate([(T, 0), (None, 1), (T - dt.timedelta(days=1), 2), (T + dt.timedelta(hours=1), 0)]):
        table.merge(spark.createDataFrame([("a", at, failures, n, 0)], schema), n)
        (r,) = table.rows(spark).collect()
        assert r.consecutive_failures == failures and r.last_successful_poll_at == (T if n < 3 else T + dt.timedelta(hours=1))


def test_observations_are_appended_and_those_without_a_price_counted(spark, tmp_path):
    schema = "used_search_id long, listing_id string, price long"
    for k, rows in enumerate([[(1, "a", 5), (1, "a", 5), (1, "b", None)], [(1, "a", 4)], []]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log/{k}")
    for _ in range(2):  # the same log from the start: the same batches come again
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/log")
        q = sinks.sunk(stream, sinks.append_observations(f"{tmp_path}/out"), f"{tmp_path}/cp{_}").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/rows").select("listing_id", "price").collect())) == [("a", 4), ("a", 5), ("a", 5)]
        tally = spark.read.parquet(f"{tmp_path}/out/tally").collect()
        assert (sum(r.inserted for r in tally), sum(r.skipped_no_price for r in tally)) == (3, 1)
