"""Queries for posts, titles and text rules, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions.price_text import normalize_price
from pricelens.operators import fold, titles

from .queries import registered
from .views import relation

#: Posts of variants by brand and type: the fold's input.
POSTS = """
SELECT p_brand || '/' || p_type AS variant_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR(20)) AS post_id,
  CAST(round(l_extendedprice) AS BIGINT) AS price, CAST({epoch} AS BIGINT) + l_linenumber * 3600 AS seen,
  CAST(CASE l_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS INTEGER) AS site, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'ENDED' ELSE 'ACTIVE' END AS status
FROM lineitem JOIN part ON l_partkey = p_partkey
"""
DUCK_POSTS = POSTS.format(epoch="epoch(l_shipdate)")
FIELDS = "deal_id := {0}.deal_id, price_first := {1}, price_min := {2}, price_max := {3}, price_last := {4}, first_seen := {5}, last_seen := {6}, sites := {7}, status := {8}, posts := {9}"
LIVE = "CASE WHEN d.status = 'ENDED' AND x[1].status <> 'ENDED' THEN 'ACTIVE' ELSE d.status END"
PUT = FIELDS.format(
    "d", "CASE WHEN x[1].first_seen < d.first_seen THEN x[1].price_first ELSE d.price_first END", "least(d.price_min, x[1].price_min)", "greatest(d.price_max, x[1].price_max)",
    "CASE WHEN d.first_seen > x[1].first_seen THEN d.price_last ELSE x[1].price_last END", "least(d.first_seen, x[1].first_seen)", "CASE WHEN d.first_seen > x[1].first_seen THEN d.last_seen ELSE x[1].last_seen END",
    "d.sites | x[1].sites", f"CASE WHEN bit_count(d.sites | x[1].sites) >= 2 AND {LIVE} = 'ACTIVE' THEN 'VERIFIED' ELSE {LIVE} END", "d.posts + x[1].posts",
)
CAN = "abs(d.price_first - x[1].price_first) <= greatest((d.price_first * 2 + 50) // 100, 5000) AND abs(d.first_seen - x[1].first_seen) <= 172800"


@registered(f"""WITH p AS ({DUCK_POSTS}),
l AS (SELECT variant_id, list([struct_pack(deal_id := post_id, price_first := price, price_min := price, price_max := price, price_last := price, first_seen := seen, last_seen := seen, sites := site, status := status, posts := 1)] ORDER BY post_id) AS xs FROM p GROUP BY 1),
f AS (SELECT variant_id, unnest(list_reduce(xs[2:], lambda acc, x: CASE WHEN list_position(list_transform(acc, lambda d: {CAN}), true) > 0
  THEN list_transform(acc, lambda d, i: CASE WHEN i = list_position(list_transform(acc, lambda d: {CAN}), true) THEN struct_pack({PUT}) ELSE d END) ELSE acc || x END, xs[1])) AS d FROM l)
SELECT variant_id, d.deal_id, d.price_first, d.price_min, d.price_max, d.price_last, d.first_seen, d.last_seen, d.sites, d.status, d.posts FROM f""")
def merged_deals(spark: SparkSession, sf: str) -> DataFrame:
    return fold.fold_deals(relation(spark, sf, POSTS.format(epoch="unix_micros(CAST(l_shipdate AS TIMESTAMP)) / 1000000")))


TITLES = """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR(20)) AS post_id, p_name AS product, p_brand AS brand,
  CAST(round(l_extendedprice) AS BIGINT) AS price, CAST(l_quantity AS BIGINT) % 6 AS q,
  '[' || p_brand || '] ' || p_name || ' ' || p_size || 'G ' || p_type || ' (' || {fmt} || '원/' ||
    CASE CAST(l_quantity AS BIGINT) % 6 WHEN 0 THEN '무료' WHEN 1 THEN '3,000원' WHEN 2 THEN '유배' WHEN 3 THEN '착불' WHEN 4 THEN '픽업' ELSE '3,000원~' END || ')' AS title
FROM lineitem JOIN part ON l_partkey = p_partkey
"""
SPARK_TITLES = TITLES.format(fmt="format_number(CAST(round(l_extendedprice) AS BIGINT), 0)")
DUCK_TITLES = TITLES.format(fmt="format('{:,}', CAST(round(l_extendedprice) AS BIGINT))")


@registered(f"""WITH t AS ({DUCK_TITLES}) SELECT post_id, price + CASE WHEN q IN (1, 5) THEN 3000 ELSE 0 END AS won,
  CASE q WHEN 2 THEN '유료배송(금액미상),배송비미상' WHEN 3 THEN '배송비:착불,배송비미상' WHEN 4 THEN '수령:픽업' WHEN 5 THEN '배송비:3,000원~,배송비미상' ELSE '' END AS tags FROM t""")
def title_prices(spark: SparkSession, sf: str) -> DataFrame:
    p = normalize_price(F.col("title"))
    return relation(spark, sf, SPARK_TITLES).select("post_id", p.alias("p")).select("post_id", "p.won", F.array_join("p.tags", ",").alias("tags"))


#: Aliases for two names in three; names of two words, of which the second is shared.
@registered("""WITH n AS (SELECT DISTINCT p_name AS product FROM part), t AS (""" + DUCK_TITLES + """),
a AS (SELECT product, replace(product, ' ', '') AS key FROM n WHERE length(product) % 3 <> 0), w AS (SELECT product, unnest(string_split(product, ' ')) AS w FROM n),
d AS (SELECT DISTINCT product AS name, title FROM t), j AS (SELECT title, regexp_replace(regexp_replace(title, '([0-9])G ', '\\1GB '), '\\s+', '', 'g') AS j FROM d),
h AS (SELECT title, count(DISTINCT a.product) AS n, min(a.product) AS own FROM j JOIN a ON contains(j.j, a.key) GROUP BY 1),
c AS (SELECT title, min(w.product) AS near FROM (SELECT title, unnest(string_split(title, ' ')) AS w FROM d) x JOIN w USING (w) GROUP BY 1)
SELECT post_id, CASE WHEN n = 1 THEN 'CONFIRMED' WHEN near IS NOT NULL THEN 'CANDIDATE' ELSE 'REJECTED' END AS tier, CASE WHEN n = 1 THEN own ELSE near END AS product FROM t LEFT JOIN h USING (title) LEFT JOIN c USING (title)""")
def matched_titles(spark: SparkSession, sf: str) -> DataFrame:
    names = relation(spark, sf, "SELECT DISTINCT p_name AS product, p_name AS name FROM part")
    aliases = names.filter(F.length("name") % 3 != 0).select("product", F.col("name").alias("alias"))
    return titles.match_products(relation(spark, sf, SPARK_TITLES), aliases, names)


@registered(f"""WITH t AS ({DUCK_TITLES}), d AS (SELECT post_id, brand AS variant_id, title FROM t)
SELECT variant_id, count(*) AS n FROM d WHERE NOT contains(title, '착불') AND NOT (variant_id = 'Brand#2' AND contains(title, 'ECONOMY')) GROUP BY 1""")
def keyword_filter(spark: SparkSession, sf: str) -> DataFrame:
    posts = relation(spark, sf, SPARK_TITLES).select(F.col("post_id").alias("deal_id"), F.col("brand").alias("variant_id"), "title")
    words = spark.createDataFrame([(None, " 착불 "), ("Brand#2", "ECONOMY"), ("Brand#3", " ")], "variant_id string, keyword string")
    return titles.exclude_keywords(posts.select("deal_id", "variant_id"), posts.select("deal_id", "title"), words).groupBy("variant_id").agg(F.count("*").alias("n"))


@registered("""WITH w AS (SELECT DISTINCT doc_id, lang, unnest(string_split_regex(regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), '[ \t\n\x0B\f\r]+')) AS w FROM documents WHERE doc_id % 50 <> 0)
SELECT lang AS variant_id, w AS keyword, count(*) AS titles FROM w WHERE length(w) >= 2 AND regexp_matches(w, '[A-Za-z가-힣]') AND w NOT IN ('the', 'of') GROUP BY 1, 2 HAVING count(*) >= 2""")
def suggested_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each variant and keyword, so no variant's words are one row; pinned deals' titles are left out."""
    docs = relation(spark, sf, "SELECT doc_id, lang AS variant_id, text AS title FROM documents")
    return titles.suggested_rows(docs, spark.createDataFrame([("the",), ("of",)], "keyword string"), docs.filter("doc_id % 50 = 0").select("doc_id"), "doc_id")
