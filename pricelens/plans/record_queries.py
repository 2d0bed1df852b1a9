"""Queries for records and queues, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.operators import limits, records

from .queries import OCCURRED, PRICING, WITH, deals, registered
from .views import PURCHASES, relation

#: Ids repeat; what arrives last wins.
RAW = """
SELECT CASE l_suppkey % 3 WHEN 0 THEN 'ppomppu' WHEN 1 THEN 'ruliweb' ELSE 'fmkorea' END AS site, l_orderkey || '-' || l_linenumber AS post_id, CAST(round(l_extendedprice) AS BIGINT) AS price,
  l_shipdate AS captured, l_partkey, l_suppkey, CASE WHEN l_quantity = 3 THEN repeat('x', 301) ELSE p_name END AS title
FROM lineitem JOIN part ON l_partkey = p_partkey
"""
SOURCES = """
SELECT l_orderkey AS deal_id, CAST(round(l_extendedprice) AS BIGINT) AS price, l_shipdate + l_linenumber * INTERVAL '1' HOUR AS captured, CASE WHEN l_returnflag = 'R' THEN 'SOLD_OUT' ELSE 'ACTIVE' END AS status
FROM lineitem
"""
OPEN = """
SELECT o_orderkey AS deal_id, CAST(round(o_totalprice / 4) AS BIGINT) AS price_min, CAST(round(o_totalprice / 4) AS BIGINT) AS price_max, CAST(round(o_totalprice / 4) AS BIGINT) AS price_last, o_orderdate AS last_seen,
  CASE WHEN o_orderstatus = 'F' THEN 'ENDED' ELSE 'ACTIVE' END AS status FROM orders
"""


@registered(f"""WITH r AS ({RAW}) SELECT site, post_id, arg_max(price, (captured, l_partkey, l_suppkey, price)) AS price, max(captured) AS captured FROM r WHERE length(title) <= 300 GROUP BY 1, 2""")
def raw_records(spark: SparkSession, sf: str) -> DataFrame:
    return records.raw_records(relation(spark, sf, RAW), ["captured", "l_partkey", "l_suppkey", "price"])[0].select("site", "post_id", "price", "captured")


@registered(f"WITH r AS ({RAW}) SELECT site, 'title' AS violation, count(*) AS n FROM r WHERE length(title) > 300 GROUP BY 1")
def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return records.raw_records(relation(spark, sf, RAW), ["captured"])[1].groupBy("site", "violation").agg(F.count("*").alias("n"))


@registered(f"""WITH s AS ({SOURCES}), d AS ({OPEN}), g AS (SELECT deal_id, min(price) AS lo, max(price) AS hi, max(captured) AS seen, first(price ORDER BY captured DESC, price) FILTER (status = 'ACTIVE') AS last FROM s GROUP BY 1),
n AS (SELECT d.*, least(price_min, lo) AS a, greatest(price_max, hi) AS b, coalesce(last, price_last) AS c, greatest(last_seen, seen) AS e FROM d JOIN g USING (deal_id) WHERE status <> 'ENDED')
SELECT deal_id, a AS price_min, b AS price_max, c AS price_last, e AS last_seen FROM n WHERE a <> price_min OR b <> price_max OR c <> price_last OR e <> last_seen""")
def refreshed_prices(spark: SparkSession, sf: str) -> DataFrame:
    return records.refresh_prices(relation(spark, sf, OPEN), relation(spark, sf, SOURCES))


@registered(f"WITH s AS ({SOURCES}), d AS ({OPEN}) SELECT deal_id, max(captured) AS last_seen FROM s JOIN d USING (deal_id) WHERE d.status <> 'ENDED' GROUP BY 1 HAVING bool_and(s.status <> 'ACTIVE')")
def ended_deals(spark: SparkSession, sf: str) -> DataFrame:
    return records.ended_deals(relation(spark, sf, OPEN), relation(spark, sf, SOURCES))


@registered("SELECT event_type || ':' || user_id AS dedup_key, count(*) AS occurrences, arg_min(props, (ts, event_id)) AS payload, max(ts) AS last_seen FROM events GROUP BY 1")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return records.enqueue(relation(spark, sf, "SELECT event_type || ':' || user_id AS dedup_key, props AS payload, ts AS at, event_id AS id FROM events"))


@registered(f"""{WITH}, b AS (SELECT DISTINCT variant_id FROM purchases WHERE state = 'CLOSED')
SELECT p_partkey AS product, b.variant_id IS NULL AND p_size % 9 <> 0 AS waiting, CASE WHEN p_size % 4 = 0 THEN p_size END AS rank FROM part LEFT JOIN b ON p_partkey = b.variant_id WHERE p_size % 11 <> 0""")
def prioritized_products(spark: SparkSession, sf: str) -> DataFrame:
    products = relation(spark, sf, "SELECT p_partkey AS product, p_size % 11 = 0 AS archived, p_size % 9 = 0 AS manually_completed, CASE WHEN p_size % 4 = 0 THEN p_size END AS rank FROM part")
    return records.prioritized(products, relation(spark, sf, PURCHASES).filter("state = 'CLOSED'").select(F.col("variant_id").alias("product")))


@registered("SELECT p_partkey AS listing_id, p_retailprice AS price, 'brand=' || p_brand || CASE WHEN p_size % 3 = 0 THEN '' ELSE ',type=' || p_type END AS axes FROM part WHERE p_size % 2 = 0")
def comparison_table(spark: SparkSession, sf: str) -> DataFrame:
    part = relation(spark, sf, "SELECT p_partkey AS listing_id, p_retailprice AS price, CASE WHEN p_size % 2 = 0 THEN 'ACTIVE' ELSE 'SOLD' END AS status, p_brand, p_type, p_size FROM part")
    axes = part.select("listing_id", F.lit("type").alias("axis"), F.col("p_type").alias("value")).filter("p_size % 3 <> 0").unionByName(part.select("listing_id", F.lit("brand").alias("axis"), F.col("p_brand").alias("value")))
    entries = F.transform(F.map_entries("values"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return records.comparison(part, axes).select("listing_id", "price", F.array_join(entries, ",").alias("axes"))


@registered("""WITH t AS (SELECT *, replace(lower(p_name || ' / ' || p_type), ' ', '') AS t FROM part)
SELECT p_partkey AS listing_id, p_size % 3 AS used_search_id, contains(t, 'ring') AS badge FROM t
WHERE contains(t, 'o') AND NOT contains(t, 'gear') AND (contains(t, '/eco') OR contains(t, '/pro') OR contains(t, '/sta'))""")
def used_matches(spark: SparkSession, sf: str) -> DataFrame:
    listings = relation(spark, sf, "SELECT p_partkey AS listing_id, p_size % 3 AS used_search_id, p_name || ' / ' || p_type AS title FROM part")
    searches = spark.createDataFrame([(i, ["O"], ["Gear"], [["/ Eco", "/ PRO", "/ sta"]], ["ring"]) for i in range(3)], "used_search_id int, required array<string>, excluded array<string>, triggers array<array<string>>, bonus array<string>")
    return records.used_match(listings, searches)


#: Every width from 6 to 12 months is counted by itself.
@registered(f"""{WITH}, s AS (SELECT * FROM deals WHERE {PRICING}), o AS (SELECT variant_id, min(first_seen) AS since FROM deals GROUP BY 1),
w AS (SELECT purchase_id, any_value(purchased_at) AS at, any_value(p.variant_id) AS v, m.m, count(*) AS held FROM purchases p CROSS JOIN range(6, 13) m(m) JOIN s ON s.variant_id = p.variant_id AND first_seen BETWEEN purchased_at - to_months(CAST(m.m AS INTEGER)) AND purchased_at GROUP BY purchase_id, m.m),
e AS (SELECT purchase_id, min(m) AS eff FROM (SELECT *, max(held) OVER (PARTITION BY purchase_id) AS most FROM w) WHERE held >= 7 OR held = most GROUP BY 1),
g AS (SELECT purchase_id, count(*) AS n, count(*) FILTER (n_sites >= 2) AS m, CAST(round(quantile_cont(price_first, 0.5)) AS BIGINT) AS med, min(price_first) AS least FROM purchases p JOIN e USING (purchase_id) JOIN s
  ON p.variant_id = s.variant_id AND first_seen BETWEEN purchased_at - to_months(CAST(eff AS INTEGER)) AND purchased_at GROUP BY 1),
r AS (SELECT purchase_id, paid_price, coalesce(purchased_at < since, false) AS un, coalesce(n, 0) AS n, coalesce(m, 0) AS m, med, least FROM purchases LEFT JOIN g USING (purchase_id) LEFT JOIN o USING (variant_id))
SELECT purchase_id, un AS unobserved, CASE WHEN un THEN 0 ELSE n END AS n, CASE WHEN un THEN 0 ELSE m END AS m, CASE WHEN NOT un AND n >= 5 THEN med END AS benchmark_price,
  CASE WHEN un THEN NULL WHEN n >= 5 THEN 'SUFFICIENT' WHEN n > 0 THEN 'SPARSE' ELSE 'NONE' END AS tier, CASE WHEN NOT un AND n BETWEEN 1 AND 4 THEN least END AS sparse_lowest, CASE WHEN NOT un AND n >= 5 THEN paid_price - med END AS paid_gap, 'P=6mo,K=5' AS basis FROM r""")
def asof_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return records.asof_snapshots(relation(spark, sf, PURCHASES), deals(spark, sf))


#: The first window's end is found by recursion, one window at a time.
@registered("""WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) AS t FROM events),
w AS (SELECT key, min(t) AS s FROM e GROUP BY 1 UNION ALL SELECT w.key, (SELECT min(t) FROM e WHERE e.key = w.key AND e.t >= w.s + 86400000000) FROM w WHERE w.s IS NOT NULL),
c AS (SELECT w.key, w.s, count(*) AS n FROM w JOIN e ON e.key = w.key AND e.t >= w.s AND e.t < w.s + 86400000000 GROUP BY 1, 2)
SELECT key, CAST(sum(least(n, 2)) AS BIGINT) AS accepted, CAST(sum(n - least(n, 2)) AS BIGINT) AS rejected FROM c GROUP BY 1""")
def rate_limits(spark: SparkSession, sf: str) -> DataFrame:
    events = relation(spark, sf, "SELECT user_id AS key, unix_micros(CAST(ts AS TIMESTAMP)) AS at FROM events")
    return limits.rate_limited(events, 2, 86_400_000_000)


@registered(f"""{WITH} SELECT variant_id, count(*) FILTER (first_seen >= TIMESTAMP '2001-02-01' AND first_seen < TIMESTAMP '2001-03-01') AS in_window, count(*) AS ever,
  min(CASE WHEN status = 'ENDED' THEN price_min ELSE price_last END) FILTER (first_seen >= TIMESTAMP '2001-02-01' AND first_seen < TIMESTAMP '2001-03-01') AS best FROM deals WHERE {OCCURRED} GROUP BY 1""")
def digest_opportunities(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return records.opportunities(deals(spark, sf), at("2001-02-01"), at("2001-03-01"))
