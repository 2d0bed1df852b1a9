"""Entity resolution over the driver's tables, with DuckDB SQL written from the model's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.operators import matching

from .more_queries import DUCK_TITLES, SPARK_TITLES
from .queries import registered
from .views import relation

#: A product for each part name, a variant for each of its sizes, a demand axis of its types; two names in three have an alias.
PRODUCTS = "SELECT min(p_partkey) AS product_id, p_name AS name FROM part GROUP BY p_name"
VARIANTS = "SELECT min(p_partkey) AS variant_id, p_name AS name, p_size AS size FROM part GROUP BY p_name, p_size"
TYPES = "SELECT DISTINCT p_name AS name, p_type AS value FROM part"


@registered(f"""WITH t AS ({DUCK_TITLES}), p AS ({PRODUCTS}), v AS (SELECT product_id, variant_id, size || 'GB' AS axis FROM ({VARIANTS}) JOIN p USING (name)), d AS (SELECT product_id, value, replace(value, ' ', '') AS key FROM ({TYPES}) JOIN p USING (name)),
a AS (SELECT product_id, replace(name, ' ', '') AS key FROM p WHERE length(name) % 3 <> 0), w AS (SELECT product_id, unnest(string_split(name, ' ')) AS w FROM p),
x AS (SELECT DISTINCT title, regexp_replace(regexp_replace(title, '([0-9])G ', '\\1GB '), '\\s+', '', 'g') AS j FROM t),
h AS (SELECT title, j, min(a.product_id) AS product_id FROM x JOIN a ON contains(j, key) GROUP BY ALL HAVING count(DISTINCT a.product_id) = 1),
f AS (SELECT title, count(*) AS n, min(variant_id) AS variant_id FROM h JOIN v USING (product_id) WHERE contains(j, axis) GROUP BY 1),
e AS (SELECT title, min(value) AS value FROM h JOIN d USING (product_id) WHERE contains(j, key) GROUP BY 1 HAVING count(*) = 1),
c AS (SELECT title, array_to_string(list_sort(list(DISTINCT w.product_id)), ',') AS ids FROM (SELECT title, unnest(string_split(title, ' ')) AS w FROM x WHERE title NOT IN (SELECT title FROM h)) JOIN w USING (w) GROUP BY 1)
SELECT post_id, CASE WHEN f.n = 1 THEN 'CONFIRMED' WHEN h.title IS NOT NULL THEN 'UNKNOWN' WHEN c.ids IS NOT NULL THEN 'CANDIDATE' ELSE 'REJECTED' END AS tier, CASE WHEN f.n = 1 THEN f.variant_id END AS variant_id,
  CASE WHEN f.n = 1 THEN NULL WHEN h.title IS NOT NULL THEN CAST(h.product_id AS VARCHAR) ELSE c.ids END AS candidates, CASE WHEN f.n = 1 THEN e.value END AS demand_axis_value
FROM t LEFT JOIN h USING (title) LEFT JOIN f USING (title) LEFT JOIN e USING (title) LEFT JOIN c USING (title)""")
def resolved_posts(spark: SparkSession, sf: str) -> DataFrame:
    products = relation(spark, sf, PRODUCTS)
    variants = relation(spark, sf, VARIANTS).join(products, "name").select("variant_id", "product_id", F.array(F.concat(F.col("size").cast("string"), F.lit("G"))).alias("axis_values"))
    axes = relation(spark, sf, TYPES).join(products, "name").groupBy("product_id").agg(F.array_sort(F.collect_list("value")).alias("allowed_values")).select(F.col("product_id").alias("id"), "product_id", F.lit("DEMAND").alias("axis_type"), "allowed_values")
    aliases = products.filter(F.length("name") % 3 != 0).select(F.col("product_id").alias("id"), "product_id", F.col("name").alias("alias"))
    got = matching.match(relation(spark, sf, SPARK_TITLES), aliases, products, variants, axes)
    return got.withColumn("candidates", F.array_join("candidates", ","))


@registered(f"""WITH t AS ({DUCK_TITLES}), x AS (SELECT DISTINCT product, title FROM t WHERE q = 0) SELECT product AS product_id, min(title) AS alias FROM x GROUP BY product, regexp_replace(title, '\\s+', '', 'g') HAVING length(product) % 3 = 0""")
def learned_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Titles with free shipping as if a person had confirmed them; names of which two in three are aliases as whole titles already."""
    t = relation(spark, sf, SPARK_TITLES).filter("q = 0").select(F.col("product").alias("product_id"), "title")
    known = t.filter(F.length("product_id") % 3 != 0).select(F.col("title").alias("alias"))
    return matching.learned_aliases(known, t)


@registered("""WITH d AS (SELECT l_partkey AS variant_id, p_type AS demand_axis_value, p_size % 3 = 0 AS split FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT variant_id, count(*) AS n FROM d WHERE NOT split OR demand_axis_value = 'STANDARD' GROUP BY 1""")
def demand_scoped(spark: SparkSession, sf: str) -> DataFrame:
    deals = relation(spark, sf, "SELECT l_partkey AS variant_id, p_type AS demand_axis_value FROM lineitem JOIN part ON l_partkey = p_partkey")
    modes = relation(spark, sf, "SELECT p_partkey AS variant_id, CASE WHEN p_size % 3 = 0 THEN 'SPLIT' ELSE 'GROUPED' END AS demand_axis_mode FROM part")
    return matching.demand_scope(deals, modes, F.lit("STANDARD")).groupBy("variant_id").agg(F.count("*").alias("n"))
