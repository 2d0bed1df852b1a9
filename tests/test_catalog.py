"""Plain reads: what is asked is in the scan, and fewer rows are read."""

from pricelens.sources import catalog


def test_conditions_reach_the_files(spark, tmp_path):
    df = spark.range(100_000).selectExpr("id % 1000 AS variant_id", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'ACTIVE' END AS status", "id AS price", "uuid() AS note")
    catalog.laid_out(df, f"{tmp_path}/deals", "variant_id", 10)

    def read(q):
        rows = q.collect()
        scan = next(n for n in leaves(q._jdf.queryExecution().executedPlan()) if "Scan" in n.nodeName())
        return rows, scan.toString(), scan.metrics().apply("numOutputRows").value()

    def leaves(plan):
        plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.nodeName() else plan
        it = plan.collectLeaves()
        return [it.apply(i) for i in range(it.size())]

    rows, plan, n = read(catalog.scan(spark, f"{tmp_path}/deals", "price", variant_id=7))
    assert len(rows) == 100 and "EqualTo(variant_id,7)" in plan and "note" not in plan and n < 30_000
    rows, plan, n = read(catalog.scan(spark, f"{tmp_path}/deals", "price", "status", variant_id=[3, 5], status=None))
    assert len(rows) == sum(i % 1000 in (3, 5) and i % 3 == 0 for i in range(100_000)) and "In(variant_id, [3,5])" in plan and "IsNull(status)" in plan and n < 30_000
    assert catalog.scan(spark, f"{tmp_path}/deals", variant_id=[]).collect() == []
    rows, plan, _ = read(catalog.others(catalog.scan(spark, f"{tmp_path}/deals"), status="ENDED").select("price"))
    assert len(rows) == sum(i % 3 != 0 for i in range(100_000)) and "Not(EqualTo(status,ENDED))" in plan


def test_searches_and_aliases(spark):
    rows = catalog.used_searches(spark.createDataFrame([(2, "B", ["a", "b c"]), (1, "X", []), (3, "B", None)], "id long, platform string, keywords array<string>")).collect()
    assert [tuple(r) for r in rows] == [(1, "X", ""), (2, "B", "a b c"), (3, "B", None)]
    got = catalog.aliases(spark.createDataFrame([(1, "a"), (None, "all"), (2, "a")], "product_id long, alias string")).collect()
    assert sorted(r.alias for r in got) == ["a", "a", "all"]
