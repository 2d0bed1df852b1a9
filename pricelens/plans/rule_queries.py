"""The small rules as queries over the driver's tables, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions import rules
from pricelens.operators import titles

from .more_queries import DUCK_TITLES, SPARK_TITLES
from .queries import registered
from .views import relation


def text(c: Column) -> Column:
    return F.array_join(c, "|")


@registered(f"""SELECT post_id, CASE WHEN NOT (contains(title, '착불') OR contains(title, 'ECONOMY')) THEN 'CLEAN' WHEN q = 4 OR q = 3 THEN 'LABELED' ELSE 'EXCLUDED' END AS verdict FROM ({DUCK_TITLES})""")
def keyword_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(F.lit("착불"), F.lit("ECONOMY"))
    return relation(spark, sf, SPARK_TITLES).select("post_id", rules.keyword_verdict(F.col("title"), words, F.col("q").isin(3, 4)).alias("verdict"))


KEYWORDS = "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE {list} END AS words FROM part"
WORDS = "' ' || p_brand, p_type || '  ', '', '   ', p_brand, p_name, p_type"


@registered("WITH k AS (" + KEYWORDS.format(list=f"[{WORDS}]") + "), t AS (SELECT p_partkey, unnest(range(1, len(words) + 1)) AS i, trim(words[i]) AS w FROM k), f AS (SELECT p_partkey, w, min(i) AS i FROM t WHERE w <> '' GROUP BY ALL) SELECT k.p_partkey, coalesce(string_agg(f.w, '|' ORDER BY f.i), '') AS words FROM k LEFT JOIN f USING (p_partkey) GROUP BY 1")
def keyword_lists(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, KEYWORDS.format(list=f"array({WORDS})")).select("p_partkey", text(rules.normalized_keywords(F.col("words"))).alias("words"))


SETTINGS = """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '["' || p_brand || '", " ' || p_type || ' ", ""]' WHEN 1 THEN chr(123) || '"a": "' || p_brand || '"' || chr(125) WHEN 2 THEN '["' || p_brand WHEN 3 THEN NULL ELSE '[]' END AS setting FROM part"""


@registered(f"SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_brand || '|' || p_type ELSE '' END AS words FROM part JOIN ({SETTINGS}) USING (p_partkey)")
def keyword_settings(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, SETTINGS).select("p_partkey", text(rules.keyword_setting(F.col("setting"))).alias("words"))


CUT = "SELECT post_id, CASE WHEN q < 3 THEN price END AS price, CASE WHEN q % 2 = 0 THEN title ELSE left(title, {n} + CAST(q AS INTEGER) * 5) || '...' END AS title, product FROM ({titles})"


@registered("SELECT post_id FROM (" + CUT.format(n=14, titles=DUCK_TITLES) + ") WHERE price IS NULL AND title LIKE '%...' AND contains(replace(title, ' ', ''), replace(product, ' ', ''))")
def detail_candidates(spark: SparkSession, sf: str) -> DataFrame:
    df = relation(spark, sf, CUT.format(n=14, titles=SPARK_TITLES))
    return df.filter(rules.needs_detail(F.col("price"), F.col("title"), F.array("product"))).select("post_id")


POLICIES = "SELECT p_partkey, p_size % 9 - 1 AS period, p_size % 14 AS k, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 4 - 1 END AS target, CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size % 27 END AS a, CASE WHEN p_size % 10 = 0 THEN NULL ELSE (p_size * 7) % 26 END AS z FROM part"


@registered(f"""SELECT p_partkey, array_to_string(list_filter([CASE WHEN period <= 0 THEN 'period' END, CASE WHEN k < 3 OR k > 10 THEN 'k_display' END, CASE WHEN target <= 0 THEN 'target' END,
  CASE WHEN (a IS NULL) <> (z IS NULL) THEN 'quiet_hours' END, CASE WHEN coalesce(a, 0) > 23 OR coalesce(z, 0) > 23 THEN 'hour' END], lambda x: x IS NOT NULL), '|') AS errors FROM ({POLICIES})""")
def policy_checks(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, POLICIES).select("p_partkey", text(rules.policy_errors(*(F.col(c) for c in ("period", "k", "target", "a", "z")))).alias("errors"))


FORMS = "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE p_name END AS name, CASE p_size % 4 WHEN 0 THEN 'GROUPED' WHEN 1 THEN 'SPLIT' WHEN 2 THEN 'OTHER' END AS mode, CASE p_size % 7 WHEN 0 THEN NULL WHEN 1 THEN {none} ELSE {one} END AS variants FROM part"


@registered("SELECT p_partkey, array_to_string(list_filter([CASE WHEN coalesce(trim(name), '') = '' THEN 'name' END, CASE WHEN coalesce(mode, '') NOT IN ('GROUPED', 'SPLIT') THEN 'mode' END, CASE WHEN coalesce(len(variants), 0) = 0 THEN 'variants' END], lambda x: x IS NOT NULL), '|') AS errors FROM (" + FORMS.format(none="CAST([] AS VARCHAR[])", one="[p_type]") + ")")
def registration_checks(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, FORMS.format(none="CAST(array() AS ARRAY<STRING>)", one="array(p_type)")).select("p_partkey", text(rules.registration_errors(F.col("name"), F.col("mode"), F.col("variants"))).alias("errors"))


AXES = "SELECT p_partkey, {a} AS a, {b} AS b, {c} AS c FROM part"


@registered("SELECT p_partkey, x || ' / ' || y || ' / ' || z AS label FROM (" + AXES.format(a="[p_brand, p_type]", b="CASE WHEN p_size % 9 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['128GB', '256GB', CAST(p_size AS VARCHAR)] END", c="string_split(p_name, ' ')") + ") AS v, unnest(a) AS p(x), unnest(b) AS q(y), unnest(c) AS r(z)")
def variant_combinations(spark: SparkSession, sf: str) -> DataFrame:
    df = relation(spark, sf, AXES.format(a="array(p_brand, p_type)", b="CASE WHEN p_size % 9 = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE array('128GB', '256GB', CAST(p_size AS STRING)) END", c="split(p_name, ' ')"))
    return df.select("p_partkey", F.explode(rules.variant_labels([F.col("a"), F.col("b"), F.col("c")])).alias("label"))


LISTS = "SELECT p_partkey, p_name || ', ' || p_type || {line} || '  ' || p_type || ' ,,' || {line} || p_brand AS words FROM part"


@registered("SELECT p_partkey, p_name || '|' || p_type || '|' || p_brand AS words FROM (SELECT p_partkey, p_name, p_type, p_brand FROM part)")
def split_lists(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, LISTS.format(line="chr(10)")).select("p_partkey", text(rules.split_list(F.col("words"))).alias("words"))


@registered("SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS events FROM events GROUP BY 1")
def korean_days(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, "SELECT CAST(ts AS TIMESTAMP_NTZ) AS ts FROM events").groupBy(rules.korean_date(F.col("ts")).cast("string").alias("day")).agg(F.count("*").alias("events"))


GAUGED = "SELECT p_partkey, CASE WHEN p_size % 13 = 0 THEN 0 ELSE p_size * 10 END AS v, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 13 = 0 THEN 0 ELSE CAST(p_partkey % 400 AS INTEGER) END AS a, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 13 = 0 THEN 0 ELSE 250 END AS b FROM part"


@registered(f"""WITH g AS (SELECT *, least(v, a, b) AS lo, greatest(v, a, b) AS hi FROM ({GAUGED})), r AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) * 0.08 ELSE abs(v) * 0.1 END AS room FROM g)
SELECT p_partkey, CAST(round(10000 * CASE WHEN hi - lo + 2 * room > 0 THEN least(greatest(CAST(v - lo + room AS DOUBLE) * 100.0 / CAST(hi - lo + 2 * room AS DOUBLE), 0.0), 100.0) END) AS BIGINT) AS position FROM r""")
def gauges(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, GAUGED).select("p_partkey", F.round(10000 * rules.gauge(F.col("v"), [F.col("a"), F.col("b")])).cast("long").alias("position"))


@registered("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, list_reduce(list_transform(ls[2:], lambda x: [x]), lambda acc, x: CASE WHEN length(acc[-1]) + length(x[1]) + 1 <= 390 THEN list_concat(acc[:-2], [acc[-1] || chr(10) || x[1]]) ELSE list_concat(acc, x) END, ls[:1]) AS ps FROM l)
SELECT doc_id, CAST(len(ps) AS BIGINT) AS parts, md5(array_to_string(CASE WHEN len(ps) > 1 THEN list_transform(ps, lambda x, i: '(' || i || '/' || len(ps) || ') ' || x) ELSE ps END, chr(0))) AS digest FROM p""")
def split_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as messages of whole lines, under 400 characters where lines allow."""
    df = relation(spark, sf, "SELECT doc_id, text FROM documents WHERE text IS NOT NULL").select("doc_id", titles.split_digest(F.col("text"), 400).alias("ps"))
    return df.select("doc_id", F.size("ps").cast("long").alias("parts"), F.md5(F.array_join("ps", "\0")).alias("digest"))


WAITS = "SELECT event_id, CAST(floor(value) AS INTEGER) % 700 AS configured, event_type = 'click' AS market, CAST(user_id % 9 AS INTEGER) AS failures FROM events"


@registered(f"SELECT event_id, greatest(configured, CASE WHEN market THEN 600 ELSE 60 END) AS interval_s, CAST(CASE WHEN failures < 1 THEN 0 ELSE least(1800, 60 * power(2, failures - 1)) END AS BIGINT) AS backoff_s FROM ({WAITS})")
def poll_waits(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, WAITS).select("event_id", rules.poll_interval(F.col("configured"), F.col("market")).alias("interval_s"), rules.backoff(F.col("failures")).alias("backoff_s"))


@registered("SELECT p_partkey, 'BUNJANG#' || p_partkey AS name, 'https://api.bunjang.co.kr/api/1/find_v2.json?q=' || replace(p_brand, '#', '%23') || '%20' || replace(p_name, ' ', '%20') || '%20%EC%95%84%EC%9D%B4%ED%8F%B0&n=100' AS url FROM part")
def market_addresses(spark: SparkSession, sf: str) -> DataFrame:
    df = relation(spark, sf, "SELECT p_partkey, array(p_brand, p_name, '아이폰') AS words FROM part")
    platform = F.lit("BUNJANG")
    return df.select("p_partkey", F.concat(platform, F.lit("#"), F.col("p_partkey").cast("string")).alias("name"), rules.market_url(platform, F.col("words")).alias("url"))


RAW = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'SOLD_OUT' WHEN 1 THEN 'DELETED' WHEN 2 THEN NULL ELSE 'ACTIVE' END AS raw, CAST(round(o_totalprice) AS BIGINT) AS price FROM orders"


@registered(f"SELECT o_orderkey, CASE WHEN raw = 'SOLD_OUT' OR raw = 'DELETED' THEN 'ENDED' ELSE 'ACTIVE' END AS status FROM ({RAW})")
def post_statuses(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, RAW).select("o_orderkey", rules.post_status(F.col("raw")).alias("status"))


@registered(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN price // 2 ELSE 100000 END AS price_min, CASE WHEN o_orderkey % 3 = 0 THEN price ELSE greatest(price, 200000) END AS price_max, price AS price_last FROM (SELECT o_orderkey, raw, CASE WHEN o_orderkey % 3 = 0 THEN price ELSE price + 100000 END AS price FROM ({RAW})) WHERE coalesce(raw, '') NOT IN ('SOLD_OUT', 'DELETED')")
def price_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Live deals after a new price."""
    df = relation(spark, sf, RAW).withColumn("status", rules.post_status(F.col("raw"))).filter("status <> 'ENDED'")
    third = F.col("o_orderkey") % 3 == 0
    price = F.when(third, F.col("price")).otherwise(F.col("price") + 100_000)
    deal = F.struct(F.when(third, F.floor(price / 2)).otherwise(100_000).alias("price_min"), F.when(third, price).otherwise(200_000).alias("price_max"), F.lit(150_000).cast("long").alias("price_last"), "status")
    after = df.select("o_orderkey", deal.alias("deal"), price.alias("new")).select("o_orderkey", rules.repriced(F.col("deal"), F.col("new")).alias("d"))
    return after.select("o_orderkey", "d.price_min", "d.price_max", "d.price_last")
