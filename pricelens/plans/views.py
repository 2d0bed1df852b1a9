"""The driver's tables as relations of the deal model, as SQL that Spark and DuckDB share.

A line item with its part is a deal: its part the variant, its dates when it
was seen, its supplier the board. Flags come from columns, so that every branch
of the operators has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "TIMESTAMP '2001-03-01 00:00:00'"

DEALS = """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR(20)) AS deal_event_id,
  l_partkey AS variant_id, p_brand AS product, p_type AS demand_axis_value,
  CAST(round(l_extendedprice) AS BIGINT) AS price_first, CAST(round(l_extendedprice * (1 - l_discount)) AS BIGINT) AS price_last,
  CAST(round(l_extendedprice * (1 - l_discount)) AS BIGINT) AS price_min, CAST(round(l_extendedprice) AS BIGINT) AS price_max,
  CASE l_suppkey % 4 WHEN 0 THEN 'ppomppu' WHEN 1 THEN 'ruliweb' WHEN 2 THEN 'fmkorea' ELSE 'bunjang' END AS site,
  CASE WHEN l_suppkey % 3 = 0 THEN 2 ELSE 1 END AS n_sites,
  CASE WHEN l_quantity >= 49 THEN 'UPPER' WHEN l_quantity <= 1 THEN 'LOWER' ELSE 'NONE' END AS outlier_flag,
  l_linenumber = 7 AS permanently_excluded, l_orderkey % 50 = 0 AS unclassified,
  l_quantity = 13 AS shipping_unknown, l_quantity = 17 AS free_price,
  CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'ENDED' WHEN l_suppkey % 3 = 0 THEN 'VERIFIED' ELSE 'ACTIVE' END AS status,
  l_shipdate AS first_seen, l_shipdate + l_linenumber * INTERVAL '12' HOUR AS last_seen
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

PARAMS = """
SELECT p_partkey AS variant_id, 3 + p_size % 6 AS period_months, 3 + p_size % 8 AS k_display,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(round(p_retailprice * 50) AS BIGINT) END AS current_price,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(round(p_retailprice * 20) AS BIGINT) END AS target_price,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 24 END AS quiet_start, CASE WHEN p_size % 4 = 0 THEN NULL ELSE (p_size * 5) % 24 END AS quiet_end
FROM part
"""

PURCHASES = """
SELECT o_orderkey AS purchase_id, o_orderkey % (SELECT count(*) FROM part) AS variant_id, CAST(round(o_totalprice / 5) AS BIGINT) AS paid_price,
  o_orderdate AS purchased_at, 30 + o_orderkey % 90 AS observation_days,
  CASE o_orderstatus WHEN 'P' THEN 'OBSERVING' WHEN 'F' THEN 'REPORT_PENDING' ELSE 'CLOSED' END AS state
FROM orders
"""

OBSERVATIONS = """
SELECT user_id % 10 AS used_search_id, user_id AS listing_id, CAST(ts AS DATE) AS batch, CAST(round(value * 100) AS BIGINT) AS price, event_id
FROM events
"""

POLLS = """
SELECT event_type AS site, event_id, ts AS seen_at, CASE WHEN value < 5 THEN 'TRANSIENT' WHEN value > 400 THEN 'BLOCKED' ELSE 'OK' END AS outcome,
  CAST(floor(value) AS BIGINT) % 4 AS deal_count, CASE WHEN CAST(floor(value) AS BIGINT) % 5 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) % 4 END AS priced_count
FROM events
"""


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the driver's tables of sf_dir."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
    used = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names if n in sql}
    for n in sorted(used, key=len, reverse=True):
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(sql, **used)
