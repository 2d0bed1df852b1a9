"""Scans of boards and markets, ingestion and polling, messages: with DuckDB SQL over what the pages were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions import rules, texts
from pricelens.operators import polls, records
from pricelens.sources import html, listings

from .decision_queries import decisions
from .more_queries import DUCK_TITLES, SPARK_TITLES
from .queries import DECIDED, deals, now, params, registered
from .record_queries import OPEN, SOURCES
from .views import POLLS, relation

#: A page for each order: its items are the rows of one of three boards.
ROWS = """
SELECT l_orderkey AS page_id, CASE l_orderkey % 3 WHEN 0 THEN 'ppomppu' WHEN 1 THEN 'ruliweb' ELSE 'fmkorea' END AS site, l_orderkey % 3 AS k, CAST(l_linenumber AS BIGINT) * 100000 + l_suppkey AS post, p_name AS name, CAST(round(l_extendedprice) AS BIGINT) AS price,
  CAST(l_quantity AS BIGINT) AS votes, l_returnflag = 'R' AS over, l_linenumber % 2 = 0 AS priced, CAST(l_quantity AS BIGINT) % 24 AS hour
FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def boards(spark: SparkSession, sf: str) -> DataFrame:
    r = relation(spark, sf, ROWS)
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    won = F.format_number("price", 0)
    title = F.when(F.col("priced"), text(F.col("name"), " (", won, "원/3,000원)")).otherwise(F.col("name"))
    mark = lambda s: F.when(F.col("over"), s).otherwise("")
    ppomppu = text('<tr class="baseList bbs_new1"><td class="baseList-numb">', F.col("post"), "</td><td", mark(' class="end2"'), '><a class="baseList-title" href="view.php?id=ppomppu&no=', F.col("post"), '">', title, '</a></td><td class="baseList-rec">', F.col("votes"), ' - 1</td><td class="baseList-time">', F.lpad(F.col("hour").cast("string"), 2, "0"), ":05</td></tr>")
    ruliweb = text('<tr class="table_body normal"><td><input class="info_article_id" value="', F.col("post"), '"></td><td><div class="title_wrapper">', mark("[종료]"), '<a href="/read/', F.col("post"), '">', title, '</a></div></td><td class="recomd"><strong>', F.col("votes"), '</strong></td><td class="time">날짜 2001.02.03</td></tr>')
    fmkorea = text('<li class="li ', mark("hotdeal_var8Y"), '"><h3 class="title">', mark('<i class="hotdeal_var8Y"></i>'), '<a href="/', F.col("post"), '">', F.col("name"), "</a></h3>", F.when(F.col("priced"), text('<div class="hotdeal_info"><a>m</a><a>', won, "원</a><a>2,500원</a></div>")).otherwise(""), '<b class="pc_voted_count"><b class="count">', F.col("votes"), "</b></b></li>")
    row = F.when(F.col("k") == 0, ppomppu).when(F.col("k") == 1, ruliweb).otherwise(fmkorea)
    head = F.when(F.col("k") == 0, "<table>").when(F.col("k") == 1, '<table class="board_list_table">').otherwise('<div id="content"><div class="fm_best_widget"><ul>')
    return r.groupBy("page_id", "site", head.alias("head")).agg(F.array_join(F.collect_list(row), "").alias("rows")).select("page_id", "site", F.concat("head", "rows").alias("html"))


@registered(f"""WITH r AS ({ROWS}) SELECT page_id, site, CAST(post AS VARCHAR) AS post_id, CASE WHEN priced AND k < 2 THEN name || ' (' || format('{{:,}}', price) || '원/3,000원)' ELSE name END AS title,
  CASE k WHEN 0 THEN 'https://www.ppomppu.co.kr/zboard/view.php?id=ppomppu&no=' || post WHEN 1 THEN '/read/' || post ELSE 'https://www.fmkorea.com/' || post END AS url, CASE WHEN over THEN 'SOLD_OUT' ELSE 'ACTIVE' END AS status, votes AS reaction,
  CASE WHEN priced THEN price + CASE WHEN k < 2 THEN 3000 ELSE 2500 END END AS headline_price, '' AS applied_conditions,
  CASE k WHEN 0 THEN CASE WHEN hour = 21 + 0 OR hour > 21 THEN TIMESTAMP '2001-02-27 15:05:00' ELSE TIMESTAMP '2001-02-28 15:05:00' END + to_hours(hour) WHEN 1 THEN TIMESTAMP '2001-02-03 14:59:00' END AS posted_at FROM r""")
def board_scans(spark: SparkSession, sf: str) -> DataFrame:
    """At midnight UTC it is nine in Korea: from 21:05 on a time is more than twelve hours ahead, so of the day before."""
    return html.scan_boards(boards(spark, sf), now()).withColumn("applied_conditions", F.array_join("applied_conditions", ","))


@registered("""SELECT user_id AS page_id, CAST(event_id AS VARCHAR) AS post_id, event_type AS title, 'https://m.bunjang.co.kr/products/' || event_id AS url, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS headline_price, date_trunc('second', ts) AS posted_at,
  CASE WHEN event_id % 3 = 0 THEN 'ACTIVE' ELSE 'SOLD_OUT' END AS status, event_id % 10 AS reaction, CASE WHEN event_id % 2 = 0 THEN '' ELSE '유료배송(금액미상),배송비미상' END AS applied_conditions FROM events WHERE event_id % 7 <> 0""")
def market_scans(spark: SparkSession, sf: str) -> DataFrame:
    """An answer for each user; every seventh listing has no time."""
    e = relation(spark, sf, "SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) AS value, CAST(ts AS TIMESTAMP) AS ts FROM events")
    item = F.to_json(F.struct(
        F.col("event_id").alias("pid"), F.col("event_type").alias("name"), F.when(F.col("event_id") % 4 == 0, "문의").otherwise(F.col("value").cast("string")).alias("price"), F.when(F.col("event_id") % 3 == 0, "0").otherwise("1").alias("status"),
        F.when(F.col("event_id") % 7 != 0, F.unix_seconds("ts")).alias("update_time"), (F.col("event_id") % 2 == 0).alias("free_shipping"), (F.col("event_id") % 10).alias("num_faved"), F.lit("seller").alias("uid"),
    ))
    answers = e.groupBy(F.col("user_id").alias("page_id")).agg(F.concat(F.lit('{"list": ['), F.array_join(F.collect_list(item), ", "), F.lit("]}")).alias("json"))
    return listings.scan_listings(answers).withColumn("applied_conditions", F.array_join("applied_conditions", ","))


@registered("SELECT event_id % 4 = 0 AS dropped, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY 1")
def priced_listings(spark: SparkSession, sf: str) -> DataFrame:
    kept, dropped = listings.priced(market_scans(spark, sf))
    return kept.agg(F.lit(False).alias("dropped"), F.count("*").alias("n")).unionByName(dropped.select(F.lit(True).alias("dropped"), F.col("dropped").alias("n")))


TIMES = """
SELECT event_id, event_id % 6 AS k, event_id % 24 AS h, event_id % 60 AS m, event_id % 12 + 1 AS mo, event_id % 28 + 1 AS d FROM events
"""


@registered(f"""WITH t AS ({TIMES}) SELECT event_id, CASE k WHEN 0 THEN TIMESTAMP '2001-02-28 15:00:00' + to_hours(h) + to_minutes(m) - CASE WHEN h * 60 + m > 21 * 60 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END
  WHEN 1 THEN TIMESTAMP '2001-02-28 15:00:30' + to_hours(h) + to_minutes(m) - CASE WHEN h * 60 + m >= 21 * 60 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END
  WHEN 2 THEN make_timestamp(2001, mo, d, 14, 59, 0) WHEN 3 THEN make_timestamp(2026, mo, d, 14, 59, 0) END AS at FROM t""")
def board_times(spark: SparkSession, sf: str) -> DataFrame:
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    plain = lambda c: F.col(c).cast("string")
    text = F.when(F.col("k") == 0, F.concat(plain("h"), F.lit(":"), two("m"))).when(F.col("k") == 1, F.concat(two("h"), F.lit(":"), two("m"), F.lit(":30"))).when(F.col("k") == 2, F.concat(F.lit("날짜 2001."), two("mo"), F.lit("."), two("d")))
    text = text.when(F.col("k") == 3, F.concat(F.lit("26/"), plain("mo"), F.lit("/"), plain("d"))).when(F.col("k") == 4, F.concat(F.lit("26/13/"), plain("d"))).otherwise("어제")
    return relation(spark, sf, TIMES).select("event_id", rules.board_time(text, now()).alias("at"))


#: Titles that reach each branch: ten thousands, won, marks, bare numbers, named shipping, cards, cut ends, free, paid shipping.
BRANCHES = """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR(20)) AS post_id, CAST(round(l_extendedprice) AS BIGINT) + 1000 AS price, CAST(l_extendedprice / 1000 AS INTEGER) + 1 AS man, l_linenumber + l_suppkey * 7 + CAST(l_quantity AS INTEGER) AS k_, p_name AS name
FROM lineitem JOIN part ON l_partkey = p_partkey
"""
TITLE = """CASE k_ % 12 WHEN 0 THEN name || ' ' || man || '만원' WHEN 1 THEN name || ' ' || man || '만' || (man % 9 + 1) || '천원 무료배송' WHEN 2 THEN name || ' ' || price || '원 배송비 2,500원' WHEN 3 THEN name || ' 특가 ' || {marked} || ' 신한카드 할인'
  WHEN 4 THEN name || ' 특가 ' || price || '...' WHEN 5 THEN name || ' 무료' WHEN 6 THEN name || ' RTX ' || price WHEN 7 THEN name || ' 유배 ' || {marked} || '원 카할' WHEN 8 THEN name || ' (무료/2,500원)' WHEN 9 THEN name || ' (' || {marked} || '원~/조건부무료) 카드 결제'
  WHEN 10 THEN name || ' ' || price || 'mAh ' || {marked} || '원' ELSE name || ' 문의 ' || price || 'GB' END"""


@registered(f"""WITH b AS ({BRANCHES.replace('CAST(l_extendedprice / 1000 AS INTEGER)', 'CAST(floor(l_extendedprice / 1000) AS INTEGER)').replace('CAST(l_quantity AS INTEGER)', 'CAST(floor(l_quantity) AS INTEGER)')}), t AS (SELECT post_id, k_ % 12 AS k, price, man FROM b)
SELECT post_id, CASE k WHEN 0 THEN man * 10000 WHEN 1 THEN man * 10000 + (man % 9 + 1) * 1000 WHEN 2 THEN price + 2500 WHEN 3 THEN price WHEN 4 THEN price WHEN 5 THEN 0 WHEN 7 THEN price WHEN 8 THEN 2500 WHEN 9 THEN price WHEN 10 THEN price END AS won,
  CASE k WHEN 3 THEN '신한카드' WHEN 4 THEN '배송비미상' WHEN 5 THEN '무료가' WHEN 7 THEN '카할,유료배송(금액미상),배송비미상' WHEN 8 THEN '무료가' WHEN 9 THEN '카드결제,조건부무료배송:조건부무료,배송비미상' WHEN 6 THEN NULL WHEN 11 THEN NULL ELSE '' END AS tags FROM t""")
def price_branches(spark: SparkSession, sf: str) -> DataFrame:
    from pricelens.functions.price_text import normalize_price

    sql = f"SELECT post_id, {TITLE.format(marked='format_number(price, 0)')} AS title FROM ({BRANCHES.replace('CAST(l_extendedprice / 1000 AS INTEGER)', 'CAST(floor(l_extendedprice / 1000) AS INTEGER)')})"
    return relation(spark, sf, sql).select("post_id", normalize_price(F.col("title")).alias("p")).select("post_id", "p.won", F.array_join("p.tags", ",").alias("tags"))


@registered(f"""WITH s AS ({SOURCES}), d AS ({OPEN}), c AS (SELECT deal_id, list_sort(list(DISTINCT CASE WHEN status = 'ACTIVE' THEN 'a' ELSE 's' END)) AS c FROM s GROUP BY 1) SELECT deal_id, array_to_string(c, ',') AS conditions FROM d JOIN c USING (deal_id) WHERE deal_id % 4 <> 0 OR c <> ['a', 's']""")
def preserved_conditions(spark: SparkSession, sf: str) -> DataFrame:
    have = F.when(F.col("deal_id") % 4 == 0, F.array(F.lit("a"), F.lit("s")))
    s = relation(spark, sf, SOURCES).select("deal_id", F.array(F.when(F.col("status") == "ACTIVE", "a").otherwise("s")).alias("conditions"))
    got = records.preserved_conditions(relation(spark, sf, OPEN).select("deal_id", have.alias("conditions")), s)
    return got.withColumn("conditions", F.array_join("conditions", ","))


LINKS = "SELECT l_orderkey AS deal_id, l_linenumber * 1000000 + l_partkey AS id, CASE l_suppkey % 3 WHEN 0 THEN 'ppomppu' WHEN 1 THEN 'ruliweb' ELSE 'fmkorea' END AS site, 'http://' || l_partkey || '/' || l_linenumber AS url FROM lineitem"


@registered(f"""WITH l AS ({LINKS}), d AS ({OPEN}), g AS (SELECT deal_id, array_to_string(list_sort(list(DISTINCT site)), ',') AS sites, arg_min(site, (id, site)) AS site, arg_min(url, id) AS source_url FROM l GROUP BY 1) SELECT deal_id, sites, source_url FROM d LEFT JOIN g USING (deal_id)""")
def hydrated_deals(spark: SparkSession, sf: str) -> DataFrame:
    got = records.hydrated(relation(spark, sf, OPEN), relation(spark, sf, LINKS))
    return got.select("deal_id", F.array_join("sites", ",").alias("sites"), "source_url")


@registered(f"""WITH s AS ({SOURCES}), d AS ({OPEN}), g AS (SELECT deal_id, first(price ORDER BY captured DESC, price) FILTER (status = 'ACTIVE') AS last FROM s GROUP BY 1)
SELECT deal_id, price_last AS was, last AS now FROM d JOIN g USING (deal_id) WHERE status <> 'ENDED' AND last > price_last AND deal_id % 3 = 0""")
def pinned_increases(spark: SparkSession, sf: str) -> DataFrame:
    d = relation(spark, sf, OPEN)
    pins = d.select("deal_id", F.when(F.col("deal_id") % 3 == 0, "ACTIVE").otherwise("DROPPED").alias("state"))
    return records.pinned_increases(d, records.refresh_prices(d, relation(spark, sf, SOURCES)), pins)


@registered("SELECT CASE WHEN l_suppkey % 4 = 3 THEN 'SKIPPED_SITE' WHEN l_quantity = 5 THEN 'SKIPPED_NO_PRICE' ELSE l_returnflag END AS result, count(*) AS n FROM lineitem GROUP BY 1")
def ingest_tally(spark: SparkSession, sf: str) -> DataFrame:
    posts = relation(spark, sf, "SELECT CASE l_suppkey % 4 WHEN 0 THEN 'ppomppu' WHEN 1 THEN ' Ruliweb' WHEN 2 THEN 'fmkorea' ELSE 'bunjang' END AS site, CASE WHEN l_quantity <> 5 THEN l_extendedprice END AS price, l_returnflag AS tier FROM lineitem")
    return records.ingest_tally(posts)


CHECKS = "SELECT event_type AS component, event_id AS check_id, ts AS seen_at, value >= 40 AS ok FROM events"


@registered(f"""WITH c AS ({CHECKS}), r AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY component ORDER BY seen_at, check_id) AS run FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY component, run, ok ORDER BY seen_at, check_id) AS n FROM r) SELECT component, check_id FROM n WHERE NOT ok AND n = 3""")
def health_alarms(spark: SparkSession, sf: str) -> DataFrame:
    return polls.health_alarms(relation(spark, sf, CHECKS))


@registered(f"WITH c AS ({CHECKS}), l AS (SELECT component, arg_max(ok, (seen_at, check_id)) AS ok FROM c GROUP BY 1) SELECT CASE WHEN bool_and(ok) THEN 'UP' ELSE 'DOWN' END AS status FROM l")
def health(spark: SparkSession, sf: str) -> DataFrame:
    return polls.health(relation(spark, sf, CHECKS))


@registered("""WITH a AS (SELECT event_type AS name, count(*) FILTER (event_id % 2 = 0) AS was, count(*) AS now FROM events GROUP BY 1) SELECT name, now - CASE WHEN name LIKE 'c%' THEN 0 ELSE was END AS delta FROM a""")
def tick_report(spark: SparkSession, sf: str) -> DataFrame:
    e = relation(spark, sf, "SELECT event_type AS name, event_id FROM events")
    count = lambda df: df.groupBy("name").agg(F.count("*").alias("value"))
    return polls.tick_report(count(e.filter("event_id % 2 = 0 AND name NOT LIKE 'c%'")), count(e))


@registered(f"""WITH t AS ({DUCK_TITLES}) SELECT brand AS site, count(*) FILTER (q <> 1) AS deals, count(*) FILTER (q = 0) AS no_price, count(*) FILTER (q >= 2) AS conditional, count(*) FILTER (q IN (2, 3, 5)) AS shipping_unknown, count(*) FILTER (q = 4) AS sold_out FROM t GROUP BY 1 UNION ALL SELECT 'silent', 0, 0, 0, 0, 0""")
def cycle_report(spark: SparkSession, sf: str) -> DataFrame:
    t = relation(spark, sf, SPARK_TITLES)
    unknown = F.when(F.col("q").isin(2, 3, 5), F.array(F.lit("배송비미상"))).when(F.col("q") == 4, F.array(F.lit("수령:픽업"))).otherwise(F.array().cast("array<string>"))
    d = t.filter("q <> 1").select(F.col("brand").alias("site"), F.when(F.col("q") > 0, F.col("price")).alias("price"), unknown.alias("conditions"), F.when(F.col("q") == 4, "SOLD_OUT").otherwise("ACTIVE").alias("status"))
    sites = t.select(F.col("brand").alias("site")).distinct().unionByName(spark.createDataFrame([("silent",)], "site string"))
    return polls.cycle_report(d, sites)


@registered(f"SELECT outcome AS http, count(*) AS n FROM ({POLLS}) GROUP BY 1")
def http_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    p = relation(spark, sf, POLLS)
    status = F.when(F.col("outcome") == "BLOCKED", 403 + 26 * (F.col("event_id") % 2)).when(F.col("outcome") == "OK", 200 + F.col("event_id") % 3).otherwise(500 - (F.col("event_id") % 2) * 199)
    return p.select(rules.http_outcome(status).alias("http")).groupBy("http").agg(F.count("*").alias("n"))


HEADS = "CASE {0} WHEN 'JACKPOT' THEN '{1}역대급 특가' WHEN 'SPECIAL' THEN '{2}특가' WHEN 'TARGET' THEN '{3}목표가 이하' WHEN 'GOOD' THEN '{2}괜찮은 딜' WHEN 'PAID_PRICE' THEN '{4}내 구매가보다 쌈' END"


@registered(DECIDED.replace("deals.variant_id, outlier_flag", "deals.variant_id, price_first, outlier_flag").replace("SELECT deal_event_id, variant_id, demand_axis_value, kinds[1]", "SELECT deal_event_id, variant_id, price_first, demand_axis_value, kinds[2:] AS rest, kinds[1]") + f""", open AS (SELECT * FROM decided WHERE (variant_id % 5 <> 0 OR coalesce(CASE WHEN variant_id % 12 <> 0 THEN demand_axis_value END IN ('STANDARD', 'PROMO'), false)) AND NOT (variant_id % 6 = 0 AND variant_id % 12 = 0))
SELECT deal_event_id, concat_ws(chr(10), {HEADS.format('kind', '🔥 ', '🟢 ', '🎯 ', '🛒 ')}, '대상 ' || variant_id, format('{{:,}}', price_first) || '원',
  CASE WHEN tier = 'SUFFICIENT' THEN '기준가 ' || format('{{:,}}', benchmark_price) || '원' || CASE WHEN benchmark_price > price_first THEN '보다 ' || format('{{:,}}', benchmark_price - price_first) || '원(' || CAST(round(CAST((benchmark_price - price_first) * 100 AS DECIMAL(20, 0)) / benchmark_price, 1) AS DECIMAL(12, 1)) || '%) 쌈' ELSE '' END || CASE WHEN period_lowest IS NOT NULL THEN ' · 역대최저 ' || format('{{:,}}', period_lowest) || '원' ELSE '' END
    WHEN tier = 'SPARSE' THEN '표본 ' || n || '건뿐이라 기준가 대신 참고' ELSE '기준 미확립(참고용)' END, CASE WHEN m > 0 THEN '✅ ' || m || '개 사이트 교차검증' END,
  '· ' || array_to_string(list_concat(list_transform(rest, lambda r: {HEADS.format('r', '', '', '', '')}), [labels]), ' · ')) AS message FROM open JOIN view USING (variant_id)""")
def alert_messages(spark: SparkSession, sf: str) -> DataFrame:
    from pricelens.operators import benchmark

    d = deals(spark, sf)
    view = benchmark.benchmark(d, params(spark, sf), now()).select("variant_id", "tier", "n", "m", "benchmark_price", "period_lowest")
    df = decisions(spark, sf).join(view, "variant_id").join(d.select("deal_event_id", "price_first"), "deal_event_id")
    name = texts.subject(F.lit("대상"), F.col("variant_id").cast("string"))
    compared = texts.comparison(F.col("price_first"), F.col("tier"), F.col("n"), F.col("benchmark_price"), F.col("period_lowest"))
    also = F.filter(F.split("also", ","), lambda x: x != "")
    return df.select("deal_event_id", texts.alert_message(F.col("kind"), also, F.array("labels"), name, F.col("price_first"), compared, F.col("m"), F.array().cast("array<string>"), F.lit(None).cast("string")).alias("message"))
