"""Steps whose figures must not grow faster than the input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricelens.functions.price_text import normalize_price
from pricelens.llm import ngram_lm
from pricelens.operators import matching, purchases, records, titles
from pricelens.sources import catalog


def below(plan: str, node: str) -> list[str]:
    """The text under each line of a plan that names node."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines, out = plan.splitlines(), []
    for i, line in enumerate(lines):
        if node in line:
            end = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))
            out.append("\n".join(lines[i + 1 : end]))
    return out


def test_purchases_are_not_broadcast_by_month(spark):
    """A range's size is known and small, the rows that explode adds to it aren't."""
    seen = F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00' + make_dt_interval(CAST(id AS INT))")
    no = F.lit(False)
    deals = spark.range(700).select((F.col("id") % 2).alias("variant_id"), (F.col("id") + 100).alias("price_first"), F.lit(1).alias("n_sites"), F.lit("NONE").alias("outlier_flag"), no.alias("permanently_excluded"), no.alias("unclassified"), no.alias("shipping_unknown"), no.alias("free_price"), seen.alias("first_seen"))
    asked = spark.range(1).select(F.col("id").alias("purchase_id"), F.lit(0).cast("long").alias("variant_id"), F.lit(500).cast("long").alias("paid_price"), F.lit(dt.datetime(2027, 7, 1)).cast("timestamp_ntz").alias("purchased_at"))
    df = records.asof_snapshots(asked, deals)
    plan = df._jdf.queryExecution().executedPlan().toString()
    sent = [x.split("Generate explode")[0] for x in below(plan, "BroadcastExchange") if "Generate explode" in x]
    assert "Generate explode" in plan and all("Aggregate" in x for x in sent)  # what is summed by purchase may be small
    # from 2027-01-01 (day 365) to 2027-07-01 (day 546), every second day
    assert [tuple(r)[:6] for r in df.collect()] == [(0, False, 91, 0, 556, "SUFFICIENT")]


def test_prices_are_no_functions_within_functions(spark):
    """Spark interprets these; numbers that no long holds are no prices."""
    df = spark.createDataFrame([(0, "x 99999999999999999999만"), (1, "x 1만9999999999999999천원 12,000원"), (2, "x (1,000원/3,000원)"), (3, "x 9223372036854775807원 배송비 1원")], "i int, t string")
    got = df.select("i", normalize_price(F.col("t")).alias("p"))
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.i: r.p and r.p.won for r in got.collect()} == {0: None, 1: 12000, 2: 4000, 3: None}


@pytest.mark.parametrize("most", [500_000, 3])
def test_titles_meet_a_small_catalog_in_place(spark, monkeypatch, most):
    """A large catalog, which is joined, gives the same."""
    monkeypatch.setattr(titles, "MOST_ALIASES", most)
    products = spark.createDataFrame([(1, "red box"), (2, "blue box"), (3, "box"), (4, "lamp")], "product_id long, name string")
    aliases = spark.createDataFrame([(1, 1, "red box"), (2, 2, "blue  box"), (3, None, "lamp"), (4, 9, "gone")], "id long, product_id long, alias string")
    variants = spark.createDataFrame([(10, 1, ["2G"]), (11, 1, ["4G"]), (20, 2, [])], "variant_id long, product_id long, axis_values array<string>")
    axes = spark.createDataFrame([(1, 1, "DEMAND", ["new", "old"]), (2, 2, "COLOR", ["new"])], "id long, product_id long, axis_type string, allowed_values array<string>")
    posts = spark.createDataFrame([(1, "red box 2G new"), (2, " red\tbox 2G 4G"), (3, "blue box new"), (4, "box\tlamp"), (5, "red box blue box"), (6, "gone"), (7, None), (8, ""), (9, "redbox 4GB old new")], "post_id long, title string")
    got = matching.match(posts, aliases, products, variants, axes)
    named = titles.match_products(posts, aliases.withColumnRenamed("product_id", "product"), products.withColumnRenamed("product_id", "product"))
    if most > 3:
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and "Exchange" not in named._jdf.queryExecution().executedPlan().toString()
    assert {r.post_id: tuple(r)[1:] for r in got.collect()} == {
        1: ("CONFIRMED", 10, None, "new"), 2: ("UNKNOWN", None, [1], None), 3: ("CONFIRMED", 20, None, None), 4: ("CANDIDATE", None, [1, 2, 3, 4], None), 5: ("CANDIDATE", None, [1, 2, 3], None),
        6: ("UNKNOWN", None, [9], None), 7: ("REJECTED", None, None, None), 8: ("REJECTED", None, None, None), 9: ("CONFIRMED", 11, None, None),
    }
    assert {r.post_id: tuple(r)[1:] for r in named.collect()} == {
        1: ("CONFIRMED", 1), 2: ("CONFIRMED", 1), 3: ("CONFIRMED", 2), 4: ("CANDIDATE", 1), 5: ("CANDIDATE", 1), 6: ("CONFIRMED", 9), 7: ("REJECTED", None), 8: ("REJECTED", None), 9: ("CONFIRMED", 1),
    }


def test_files_grow_in_number(spark, tmp_path, monkeypatch):
    """No file, nor the task that sorts it, holds much more than FILE_ROWS, even of one key; values asked for are a condition or, where many, joined."""
    monkeypatch.setattr(catalog, "FILE_ROWS", 1000, raising=False)
    catalog.laid_out(spark.range(40_000).selectExpr("CASE WHEN id < 20000 THEN 7 ELSE id END AS k", "id"), f"{tmp_path}/x", "k")
    assert spark.read.parquet(f"{tmp_path}/x").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 4000
    asked = spark.createDataFrame([(7,), (7,), (30_000,), (None,)], "v long")
    for most in (10, 1):
        monkeypatch.setattr(catalog, "MOST_ASKED", most)
        assert catalog.scan_those(spark, f"{tmp_path}/x", "k", asked).count() == 20_001


def test_chances_are_counted_only_where_they_are_told(spark, monkeypatch):
    """Purchases that a deal is on for, that wait for a report or are closed tell none; of deals only those of variants asked for are counted."""
    deals = spark.sql("""SELECT v AS variant_id, p AS price_min, p AS price_last, 'NONE' AS outlier_flag, s AS status, false AS permanently_excluded, false AS unclassified, false AS shipping_unknown, false AS free_price
      FROM VALUES (1L, 50L, 'ACTIVE'), (1L, 70L, 'ENDED'), (2L, 50L, 'ENDED'), (2L, 60L, 'ENDED'), (2L, 2000L, 'ENDED'), (3L, 1L, 'ENDED') d(v, p, s)""")
    asked = spark.sql("""SELECT id AS purchase_id, v AS variant_id, 1500L AS paid_price, TIMESTAMP_NTZ '2026-01-01 00:00:00' AS purchased_at, s AS state
      FROM VALUES (1L, 1L, 'OBSERVING'), (2L, 2L, 'OBSERVING'), (3L, 2L, 'REPORT_PENDING'), (4L, 3L, 'CLOSED'), (5L, 9L, 'OBSERVING') p(id, v, s)""")
    counted, count = [], purchases.count_below
    monkeypatch.setattr(purchases, "count_below", lambda p, sample: (counted.append(p), count(p, sample))[1])
    got = purchases.observation_context(asked, deals, F.expr("TIMESTAMP_NTZ '2026-01-03 00:00:00'"))
    assert {r.purchase_id: (r.kind, r.active_lowest, r.day, r.cheaper_chances) for r in got.collect()} == {1: ("ACTIVE_DEAL", 50, None, None), 2: ("NO_ACTIVE_DEAL", None, 3, 2), 3: ("REPORT_PENDING", None, None, None), 5: ("NO_ACTIVE_DEAL", None, 3, 0)}
    assert {r.purchase_id for r in counted[0].collect()} == {2, 5} and "LeftSemi" in count(counted[0], deals)._jdf.queryExecution().optimizedPlan().toString()


def test_contexts_are_looked_up_once(spark, tmp_path, monkeypatch):
    """However many n-grams a context has, its counts are asked for once, contexts being sorted once a level; texts scored together score as each by itself."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(["a b", w]) for w in words] + ["a b", "b a b", "c"]
    model = ngram_lm.train(spark.createDataFrame([(t.encode(),) for t in texts], "raw binary"), uri=f"file://{tmp_path}/lm")
    asked, orders, find = {}, {}, ngram_lm.Lookup.find
    monkeypatch.setattr(ngram_lm.Lookup, "find", lambda self, name, shard, keys, *columns, **more: (asked.__setitem__(name, len(keys)), orders.__setitem__(name, more.get("order")), find(self, name, shard, keys, *columns, **more))[2])
    rows = [["a", "b", w] for w in [*words, "a", "b", "c", "never"]] + [["a", "b"]]
    hashes, n = ngram_lm.hashed([[w.encode() for w in r] for r in rows], ngram_lm.Hashes())
    got = ngram_lm.Lookup(model).score(hashes, n)
    assert asked["whole-3"] <= len(rows) + 3 < asked["grams-3"] and asked["whole-2"] <= len(words) + 7 < asked["grams-2"]
    assert all(orders[f"whole-{k}"] is not None and orders[f"single-{k}"] is orders[f"whole-{k}"] is orders[f"spread-{k}"] for k in (2, 3))  # sorted once
    one = ngram_lm.Lookup(model)
    alone = [float(one.score(hashes[sum(n[:i]) : sum(n[: i + 1])], n[i : i + 1])["score"][0]) for i in range(len(n))]
    assert alone == pytest.approx(got["score"].tolist(), rel=1e-12)
