"""Matching, folding, alerts and purchases on hand-checked vectors, hot keys, and every query on empty and null tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import pricelens.plans.decision_queries
import pricelens.plans.ingest_queries
import pricelens.plans.match_queries
import pricelens.plans.more_queries
import pricelens.plans.record_queries
import pricelens.plans.review_queries
import pricelens.plans.text_queries  # noqa: F401
from pricelens.operators import alerts, benchmark, digest, fold, matching, polls, purchases, records, review, used
from pricelens.plans.queries import QUERIES, SQL

NOW = dt.datetime(2026, 7, 15)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) > 80


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Two folders: tables without rows, and tables of two rows that are null in every column."""
    empty, null = str(tmp_path_factory.mktemp("empty")), str(tmp_path_factory.mktemp("null"))
    schemas = {
        "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
        "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
        "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", "documents": "doc_id long, text string, lang string, source string, n_chars long", "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    }
    for name, schema in schemas.items():
        n = schema.count(",") + 1
        spark.createDataFrame([], schema).write.parquet(f"{empty}/{name}.parquet")
        spark.createDataFrame([(None,) * n] * 2, schema).coalesce(1).write.parquet(f"{null}/{name}.parquet")
    return empty, null


#: Queries whose keys are made of several columns count a null part as a missing row; health has no status without a component, and says so.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"health"}))
def test_queries_on_empty_and_null_tables(spark, odd_tables, name):
    empty, null = odd_tables
    assert len(QUERIES[name](spark, empty).collect()) <= 2  # totals, and sites that were polled without a deal
    QUERIES[name](spark, null).collect()


def test_health_without_components_is_an_error(spark, odd_tables):
    with pytest.raises(Exception, match="no component"):
        QUERIES["health"](spark, odd_tables[0]).collect()


def test_matching_vectors(spark):
    products = spark.createDataFrame([(1, "아이폰 17"), (2, "갤럭시 S25"), (3, "갤럭시 버즈")], "product_id long, name string")
    variants = spark.createDataFrame([(10, 1, ["256GB"]), (11, 1, ["512GB"]), (20, 2, []), (30, 3, ["1G", "x"])], "variant_id long, product_id long, axis_values array<string>")
    axes = spark.createDataFrame([(2, 1, "DEMAND", ["미국판"]), (1, 1, "DEMAND", ["자급제", "통신사", ""]), (3, 1, "PRICE", ["256GB"])], "id long, product_id long, axis_type string, allowed_values array<string>")
    aliases = spark.createDataFrame([(1, 1, "아이폰17"), (2, 2, "S25"), (3, None, "폰"), (4, 9, "없는 상품"), (5, 1, "옛이름"), (6, 2, "옛 이름")], "id long, product_id long, alias string")
    titles = {
        "아이폰 17 256기가 자급제 89만": ("CONFIRMED", 10, None, "자급제"), "아이폰 17 512GB 자급제 통신사": ("CONFIRMED", 11, None, None), "아이폰 17 자급제 특가": ("UNKNOWN", None, [1], None), "아이폰 17 256GB 512GB": ("UNKNOWN", None, [1], None),
        "애플 아이폰 신형 256기가": ("CANDIDATE", None, [1], None), "갤럭시 울트라": ("CANDIDATE", None, [2, 3], None), "S25 울트라": ("CONFIRMED", 20, None, None), "아이폰17 S25 세트": ("CANDIDATE", None, [2], None), "없는 상품 팝니다": ("UNKNOWN", None, [9], None),
        "옛이름 특가": ("CONFIRMED", 20, None, None), "모니터": ("REJECTED", None, None, None), "": ("REJECTED", None, None, None), None: ("REJECTED", None, None, None),
    }
    posts = spark.createDataFrame(list(enumerate(titles)), "post_id long, title string")
    got = {r.post_id: (r.tier, r.variant_id, r.candidates, r.demand_axis_value) for r in matching.match(posts, aliases, products, variants, axes).collect()}
    assert [got[i] for i in range(len(titles))] == list(titles.values())
    learned = matching.learned_aliases(aliases, spark.createDataFrame([(1, "아이폰 17"), (2, "새 이름"), (2, "새이름"), (2, " ")], "product_id long, title string"))
    assert [tuple(r) for r in learned.collect()] == [(2, "새 이름")]


def test_split_products_need_a_demand_value(spark):
    deals = spark.createDataFrame([(1, "a"), (1, None), (2, "a"), (2, "b"), (2, None)], "variant_id long, demand_axis_value string")
    modes = spark.createDataFrame([(2, "SPLIT")], "variant_id long, demand_axis_mode string")
    assert sorted(map(str, matching.demand_scope(deals, modes, F.lit("b")).collect())) == sorted(map(str, [*deals.filter("variant_id = 1").collect(), *deals.filter("demand_axis_value = 'b'").collect()]))
    with pytest.raises(Exception, match="needs a demand value"):
        matching.demand_scope(deals, modes).collect()


def brute_fold(posts):
    deals = []
    for post_id, price, seen, site, status in sorted(posts):
        for d in deals:
            if abs(d["first"] - price) <= max((d["first"] * 2 + 50) // 100, 5000) and abs(d["seen"] - seen) <= 48 * 3600:
                d["n"] += 1
                if seen < d["seen"]:
                    d["first"] = price
                d["seen"], d["sites"] = min(d["seen"], seen), d["sites"] | site
                break
        else:
            deals.append({"id": post_id, "first": price, "seen": seen, "sites": site, "n": 1})
    return sorted((d["id"], d["first"], d["seen"], d["sites"], d["n"]) for d in deals)


def test_fold_of_one_hot_variant(spark):
    rng = random.Random(1)
    posts = [(f"p{i:05}", rng.choice([rng.randint(1, 3), rng.randint(20, 400)]) * 3000 + rng.randint(0, 99), rng.randint(0, 6 * 86400), rng.choice([1, 2, 4]), "ACTIVE") for i in range(600)]
    df = spark.createDataFrame([(7, *p) for p in posts], "variant_id int, post_id string, price long, seen long, site int, status string")
    got = fold.fold_deals(df).select("deal_id", "price_first", "first_seen", "sites", "posts").collect()
    assert sorted(map(tuple, got)) == brute_fold(posts)
    assert fold.fold_deals(df.filter("false")).collect() == []


def test_cells_find_what_a_scan_of_all_deals_finds():
    """Prices round powers of two, the floor and zero; times round the window's bounds; deals that move."""
    rng = random.Random(2)
    price = lambda: max(0, rng.choice([0, 4096, 5000, 250_000, 262_144, 2**20, 10**7]) + rng.randint(-9000, 9000)) if rng.random() < 0.7 else int(10 ** rng.uniform(0, 8))
    for _ in range(40):
        cells, held = fold.Cells(), []
        for _ in range(60):
            at = rng.randrange(len(held) + 1)
            held[at : at + 1] = [(price(), rng.randint(-2, 2) * fold.WINDOW_S + rng.randint(-2, 2))]
            cells.put(at, *held[at])
            p, t = price(), rng.randint(-2, 2) * fold.WINDOW_S + rng.randint(-2, 2)
            assert cells.near(p, t) == [i for i, (q, s) in enumerate(held) if abs(q - p) <= max((q * 2 + 50) // 100, 5000) and abs(s - t) <= fold.WINDOW_S]


def test_cheaper_deals_of_one_hot_variant(spark):
    rng = random.Random(2)
    prices, paid = [rng.randint(0, 9000) for _ in range(800)], [(i, rng.randint(0, 9500)) for i in range(300)]
    got = purchases.count_below(spark.createDataFrame([(i, 1, p) for i, p in paid], "purchase_id long, variant_id long, paid_price long"), spark.createDataFrame([(1, p) for p in prices], "variant_id long, price_min long"))
    assert {r.purchase_id: r.chances for r in got.collect()} == {i: n for i, p in paid if (n := sum(x < p for x in prices))}


def test_cursors_of_one_hot_site(spark):
    rows = [("s", i, NOW + dt.timedelta(seconds=i), "OK" if i % 50 == 7 else "TRANSIENT") for i in range(2000)] + [("b", 1, NOW, "OK"), ("b", 2, NOW, "BLOCKED"), ("b", 3, NOW, "OK"), (None, 4, NOW, "OK")]
    got = {r.site: (r.failures, r.stopped, r.next_s) for r in polls.cursors(spark.createDataFrame(rows, "site string, event_id long, seen_at timestamp_ntz, outcome string")).collect() if r.site}
    assert got == {"s": (42, False, 1800), "b": (0, True, None)}


def test_alert_decisions(spark):
    view = spark.createDataFrame([(1, "SUFFICIENT", 9, 900, 850, None, None), (2, "SPARSE", 2, None, None, 700, None), (3, "NONE", 0, None, None, None, 1000)], "variant_id long, tier string, n long, benchmark_price long, good_deal_line long, lowest_case long, current_price long")
    policies = spark.createDataFrame([(1, 860, 22, 8), (2, None, None, None), (3, None, 8, 8)], "variant_id long, target_price long, quiet_start int, quiet_end int")
    rows = [("a", 1, 840, "NONE"), ("b", 1, 860, "NONE"), ("c", 1, 901, "LOWER"), ("d", 1, 901, "NONE"), ("e", 2, 700, "NONE"), ("f", 2, 701, "NONE"), ("g", 3, 700, "NONE"), ("h", 3, 701, "NONE"), ("i", 1, 1, "NONE")]
    deals = spark.createDataFrame([(i, v, p, f, 1 + (i == "a"), "ENDED" if i == "i" else "ACTIVE") for i, v, p, f in rows], "deal_event_id string, variant_id long, price_first long, outlier_flag string, n_sites int, status string")

    def decided(hour, bought):
        got = alerts.alert_decisions(deals, view, policies, F.lit(hour), spark.createDataFrame(bought, "variant_id long, state string, paid_price long"))
        return {r.deal_event_id: (r.kind, r.also, r.outcome) for r in got.collect()}, {r.deal_event_id: r.labels for r in got.collect()}

    got, labels = decided(23, [(3, "OBSERVING", 702)])
    assert got == {"a": ("SPECIAL", "TARGET,GOOD", "HELD"), "b": ("TARGET", "GOOD", "HELD"), "c": ("JACKPOT", "", "SENT"), "e": ("GOOD", "", "SENT"), "g": ("GOOD", "PAID_PRICE", "SENT"), "h": ("PAID_PRICE", "", "SENT")}
    assert (labels["a"], labels["e"], labels["g"]) == ("2개 사이트 검증", "미검증(단독) · 표본 2건 · 참고용", "미검증(단독) · 기준 미확립 · 참고용")
    got, _ = decided(9, [(1, "ARCHIVED", 5), (1, "ARCHIVED", 9999)])
    assert {k: v for k, v in got.items() if k in "abc"} == {"a": ("SPECIAL", "GOOD", "SENT"), "b": ("GOOD", "", "SENT")}


def test_a_cold_start_is_exact_at_seven_tenths(spark):
    """0.7 * 90 is 62.99... in doubles; a price of 63 alerts all the same."""
    view = spark.createDataFrame([(1, "NONE", 0, None, None, None, 90)], "variant_id long, tier string, n long, benchmark_price long, good_deal_line long, lowest_case long, current_price long")
    policies = spark.createDataFrame([(1, None, None, None)], "variant_id long, target_price long, quiet_start int, quiet_end int")
    deals = spark.createDataFrame([("a", 1, 63, "NONE", 1, "ACTIVE"), ("b", 1, 64, "NONE", 1, "ACTIVE")], "deal_event_id string, variant_id long, price_first long, outlier_flag string, n_sites int, status string")
    got = alerts.alert_decisions(deals, view, policies, F.lit(9), spark.createDataFrame([], "variant_id long, state string, paid_price long"))
    assert [r.deal_event_id for r in got.collect()] == ["a"]


def test_snapshots_stand_as_of_the_purchase(spark):
    day = lambda m, d: dt.datetime(2026, m, d)
    deal = lambda p, at, sites=1: (1, p, sites, "NONE", False, False, False, False, at)
    deals = spark.createDataFrame([deal(100 + i, day(1, 1 + i), 1 + i % 2) for i in range(4)] + [deal(90, day(6, 1))], "variant_id long, price_first long, n_sites int, outlier_flag string, permanently_excluded boolean, unclassified boolean, shipping_unknown boolean, free_price boolean, first_seen timestamp_ntz")
    asked = spark.createDataFrame([(1, 1, 100, day(1, 3)), (2, 1, 100, day(7, 10)), (3, 1, 100, dt.datetime(2025, 12, 31)), (4, 8, 100, day(7, 1))], "purchase_id long, variant_id long, paid_price long, purchased_at timestamp_ntz")
    got = {r.purchase_id: (r.unobserved, r.n, r.m, r.tier, r.benchmark_price, r.sparse_lowest, r.paid_gap, r.basis) for r in records.asof_snapshots(asked, deals).collect()}
    basis = "P=6mo,K=5"
    # the second finds the deals of January by its seventh month
    assert got == {1: (False, 3, 1, "SPARSE", None, 100, None, basis), 2: (False, 5, 2, "SUFFICIENT", 101, None, -1, basis), 3: (True, 0, 0, None, None, None, None, basis), 4: (False, 0, 0, "NONE", None, None, None, basis)}


def test_digest_and_pins(spark):
    at = lambda d: dt.datetime(2026, 7, d)
    w = digest.windows(spark.createDataFrame([(1, at(1)), (2, at(5)), (3, None)], "variant_id long, created_at timestamp_ntz"), spark.createDataFrame([(1, at(3)), (2, None)], "variant_id long, last_sent_at timestamp_ntz"))
    assert {r.variant_id: r.since for r in w.collect()} == {1: at(3), 2: at(5), 3: None}
    states = spark.createDataFrame([(1, at(1), "RED")], "variant_id long, last_sent_at timestamp_ntz, stored_color string")
    signals = spark.createDataFrame([(1, "GREEN"), (2, "RED")], "variant_id long, color string")
    now = F.lit(at(9)).cast("timestamp_ntz")
    after = lambda sent: sorted(tuple(r) for r in digest.bookkeeping(states, signals, spark.createDataFrame([(s,) for s in sent], "sent boolean"), now).collect())
    assert after([True, True]) == [(1, at(9), "GREEN"), (2, at(9), "RED")] and after([True, False]) == [(1, at(1), "RED"), (2, None, None)]
    pins = spark.createDataFrame([(1, 1, "ACTIVE", False), (2, 2, "BOUGHT", False), (3, 3, "ACTIVE", True)], "pin_id long, deal_event_id long, state string, revive_unacknowledged boolean")
    back = spark.createDataFrame([(1,), (2,), (1,)], "deal_event_id long")
    got = {r.pin_id: r.revive_unacknowledged for r in review.revived(pins, back, spark.createDataFrame([(3,)], "pin_id long")).collect()}
    assert got == {1: True, 2: False, 3: False}
    moves = spark.createDataFrame([("ACTIVE", "MISSED"), ("BOUGHT", "ACTIVE"), (None, "BOUGHT")], "state string, target string")
    assert [r.ok for r in purchases.transitions(moves, purchases.PIN_MOVES).collect()] == [True, False, False]


def test_benchmark_of_params_without_deals(spark):
    deals = QUERIES["sparse_cases"]
    params = spark.createDataFrame([(5, 6, 5, None), (6, 12, 3, 100)], "variant_id long, period_months int, k_display int, current_price long")
    none = spark.createDataFrame([], "deal_event_id string, variant_id long, price_first long, n_sites int, outlier_flag string, permanently_excluded boolean, unclassified boolean, shipping_unknown boolean, free_price boolean, first_seen timestamp_ntz")
    now = F.lit(NOW).cast("timestamp_ntz")
    assert {(r.variant_id, r.tier, r.n, r.lowest_case) for r in benchmark.benchmark(none, params, now).collect()} == {(5, "NONE", 0, None), (6, "NONE", 0, None)}
    assert {tuple(r) for r in benchmark.effective(none, params, now).collect()} == {(5, 6), (6, 12)} and deals is not None


def test_raw_records(spark):
    rows = [("s", "1", "a", "ACTIVE", ["x"], 1), ("s", "1", "b", "SOLD_OUT", [], 2), ("s", "2", "y" * 301, "ACTIVE", None, 1), ("t", "1", None, "DELETED", None, 1)]
    posts = spark.createDataFrame(rows, "site string, post_id string, title string, status string, applied_conditions array<string>, at int")
    kept, out = records.raw_records(posts, ["at"])
    assert sorted((r.site, r.post_id, r.status, r.derived) for r in kept.collect()) == [("s", "1", "SOLD_OUT", '{"applied_conditions":[]}'), ("t", "1", "DELETED", "{}")]
    assert [(r.post_id, r.violation) for r in out.collect()] == [("2", "title")]
    with pytest.raises(Exception, match="unknown status: GONE"):
        records.raw_records(posts.withColumn("status", F.lit("GONE")), ["at"])[0].collect()


def test_risk_and_extraction(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    words = F.array(F.lit("단 순변심"), F.lit("택배"))
    assert [tuple(r) for r in one(used.risk_signals(F.lit("단순 변심 판매"), words, F.lit(70), F.lit(100), 30))] == [(used.REPERTOIRE, "단 순변심"), (used.PRICE_RISK, "스냅샷 최저 대비 30% 이상 저렴")]
    assert one(used.risk_signals(F.lit("x"), words, F.lit(71), F.lit(100), 30)) == [] and one(used.risk_signals(F.lit(None).cast("string"), words, F.lit(1), F.lit(None).cast("int"), 30)) == []
    assert [one(used.largest_amount(F.lit(t))) for t in ("3만원에 샀고 45,000원", "12345", "")] == [45000, None, None]
