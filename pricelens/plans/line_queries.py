"""Queries of plain reads, of listings that are evaluated, and of lines that are shown, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions import review_lines
from pricelens.functions.lineage import new_folder
from pricelens.operators import evaluate, message
from pricelens.sources import catalog

from .queries import deals, registered
from .review_queries import MOVES, digest_flows, digest_transitions
from .views import DEALS, relation

SEARCHES = "SELECT p_partkey AS id, CASE p_size % 2 WHEN 0 THEN 'BUNJANG' ELSE 'OTHER' END AS platform, {list} AS keywords FROM part"


@registered("SELECT p_partkey AS id, CASE p_size % 2 WHEN 0 THEN 'BUNJANG' ELSE 'OTHER' END AS platform, p_brand || ' ' || p_name || ' ' || p_type AS query FROM part")
def search_texts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.used_searches(relation(spark, sf, SEARCHES.format(list="array(p_brand, p_name, p_type)")))


ALIASES = "SELECT CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_partkey END AS product_id, p_brand || ' ' || p_name AS alias FROM part"


@registered(f"SELECT alias FROM ({ALIASES})")
def all_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.aliases(relation(spark, sf, ALIASES))


@registered(f"SELECT deal_event_id, variant_id, price_first FROM ({DEALS}) WHERE variant_id IN (SELECT p_partkey FROM part WHERE p_size = 7) AND status <> 'ENDED'")
def live_deals_of(spark: SparkSession, sf: str) -> DataFrame:
    """Deals on of asked variants, read from files by ranges of variant."""
    path = new_folder(spark, "deals")
    catalog.laid_out(deals(spark, sf), path, "variant_id")
    asked = relation(spark, sf, "SELECT p_partkey AS v FROM part WHERE p_size = 7")
    return catalog.others(catalog.scan_those(spark, path, "variant_id", asked), status="ENDED").select("deal_event_id", "variant_id", "price_first")


NAMES = "SELECT p_partkey AS variant_id, CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_name END AS product, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS variant, p_size % 3 <> 0 AS active, CASE WHEN p_size % 5 = 0 THEN p_type END AS basis, p_size % 17 = 0 AS missed FROM part"
WAITING = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'deal ' || o_orderkey END AS subject, CAST(o_orderkey % 6 AS INTEGER) AS digest_appearances FROM orders WHERE o_orderstatus = 'P'"
COLOR = lambda c: f"CASE {c} WHEN 'GREEN' THEN '🟢GREEN' WHEN 'YELLOW' THEN '🟡YELLOW' WHEN 'RED' THEN '🔴RED' WHEN 'GRAY' THEN '⚪GRAY' ELSE '-' END"
LINES = f"""nm AS ({NAMES}), dl AS (SELECT variant_id, in_window > 0 OR reportable AS moved, CASE WHEN in_window > 0 OR best IS NOT NULL OR reportable OR missed THEN concat_ws(' · ', CASE WHEN product IS NULL AND variant IS NULL THEN '대상 미상' ELSE concat_ws(' ', product, variant) END,
  CASE WHEN best IS NOT NULL THEN CASE WHEN active THEN '🟢' ELSE '⛔' END || ' 최고 기회 ' || format('{{:,}}', best) || '원(basis=' || coalesce(basis, '전체') || ')' END, CASE WHEN reportable THEN '🔁 ' || {COLOR("was")} || ' → ' || {COLOR("now")} END,
  '관찰 이번 창 +' || in_window || ' / 누적 ' || ever, CASE WHEN missed THEN '📌 놓쳤어요' END) END AS line FROM fl JOIN mv USING (variant_id) JOIN nm USING (variant_id)),
wt AS ({WAITING})"""


def digest_lines(spark: SparkSession, sf: str) -> DataFrame:
    df = digest_flows(spark, sf).join(digest_transitions(spark, sf), "variant_id").join(relation(spark, sf, NAMES), "variant_id")
    pins = F.when(F.col("missed"), F.array(F.lit("MISSED"))).otherwise(F.array().cast("array<string>"))
    line = message.variant_line(*(F.col(c) for c in ("product", "variant", "best", "active", "basis", "was", "now", "reportable", "in_window", "ever")), pins)
    return df.select("variant_id", line.alias("line"), ((F.col("in_window") > 0) | F.col("reportable")).alias("moved"))


@registered(MOVES + f""", {LINES} SELECT 0 AS step, CAST(0 AS BIGINT) AS n, '📋 주간 다이제스트 (발송 시점 현재 지식 기준)' AS line UNION ALL SELECT 1, variant_id, line FROM dl WHERE line IS NOT NULL AND (SELECT bool_or(moved) FROM dl)
UNION ALL SELECT 2, 0, CASE WHEN NOT (SELECT bool_or(moved) FROM dl) THEN '이번 주는 조용했습니다 — 가격 변동·신호 전환 없음.' ELSE '· 나머지 ' || count(*) || '개 항목은 변동 없음' END FROM dl WHERE line IS NULL
UNION ALL SELECT 3, 0, '⑤ 검토 대기 ' || count(*) || '건(대상 미상 ' || count(*) FILTER (subject IS NULL) || '건 포함) · 최다 ' || max(digest_appearances + 1) || '회째 미확인' FROM wt""")
def digest_message(spark: SparkSession, sf: str) -> DataFrame:
    """The whole digest, line by line."""
    return message.assembled(digest_lines(spark, sf), message.queue_line(relation(spark, sf, WAITING))).select("place.step", "place.n", "line")


@registered("""WITH w AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL AND lang = 'es'),
l AS (SELECT list(line ORDER BY doc_id, i) AS ls FROM w),
p AS (SELECT list_reduce(list_transform(ls[2:], lambda x: {'c': 0, 'k': 0, 'n': length(x), 'x': CAST([] AS BIGINT[])}), lambda acc, x: CASE WHEN acc.n + x.n + 1 <= 3990 THEN {'c': acc.c, 'k': acc.k + 1, 'n': acc.n + x.n + 1, 'x': acc.x} ELSE {'c': acc.c + 1, 'k': 1, 'n': x.n, 'x': list_append(acc.x, acc.k)} END, {'c': 1, 'k': 1, 'n': length(ls[1]), 'x': CAST([] AS BIGINT[])}) AS s FROM l)
SELECT CAST(unnest(range(1, s.c + 1)) AS BIGINT) AS i, CAST(s.c AS BIGINT) AS n, CAST(unnest(list_append(s.x, s.k)) AS BIGINT) AS lines FROM p""")
def message_lines(spark: SparkSession, sf: str) -> DataFrame:
    """All lines of a language's documents in messages of under 4,000 characters: how many each holds."""
    df = relation(spark, sf, "SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND lang = 'es'").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    parts = message.message_parts(df.select(F.struct("doc_id", "i").alias("place"), "line"), 4000)
    return parts.select("i", "n", F.size(F.split("text", "\n", -1)).cast("long").alias("lines"))


SHOWN = """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'UNCLASSIFIED' WHEN 1 THEN 'OUTLIER_LOWER' WHEN 2 THEN 'DEMAND_UNKNOWN' WHEN 3 THEN 'KEYWORD_SUGGEST' ELSE 'NEW_KIND' END AS kind,
  CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'post ' || o_custkey END AS title, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'deal ' || o_custkey END AS subject, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(round(o_totalprice) AS BIGINT) END AS price,
  CASE o_custkey % 3 WHEN 0 THEN {none} WHEN 1 THEN {one} ELSE {two} END AS tags, 1 + o_orderkey % 3 AS occurrences, o_orderdate + INTERVAL '16' HOUR AS first_seen, o_orderdate + (o_custkey % 2) * INTERVAL '20' HOUR + INTERVAL '16' HOUR AS last_seen FROM orders"""
TAGGED = "CASE WHEN len(tags) > 0 THEN '조건부: ' || array_to_string(tags, ' · ') || CASE WHEN list_contains(tags, '배송비미상') THEN ' (배송비 미상이라 실제 결제가는 더 높습니다)' ELSE '' END END"


@registered("WITH q AS (" + SHOWN.format(none="CAST([] AS VARCHAR[])", one="['카할']", two="['카할', '배송비미상']") + f"""), d AS (SELECT *, CASE WHEN coalesce(title, '') = '' THEN '제목 없음' ELSE title END AS t, coalesce(subject, '대상 미상') AS s, strftime(first_seen + INTERVAL 9 HOUR, '%Y-%m-%d') AS a, strftime(last_seen + INTERVAL 9 HOUR, '%Y-%m-%d') AS b FROM q)
SELECT id, length(CASE kind WHEN 'UNCLASSIFIED' THEN '미상 — 어느 제품인지 확정하지 못했습니다. 사람이 원문을 보고 정합니다.' WHEN 'OUTLIER_LOWER' THEN '분포 하단 이상치 — 기준가 표본에서 제외됐습니다. 원문을 보고 판단하세요.' WHEN 'DEMAND_UNKNOWN' THEN '수요축 값 미상 — 제목에서 값을 판별하지 못해 기준가에서 빠졌습니다. 원문을 보고 분류하세요.'
    WHEN 'KEYWORD_SUGGEST' THEN '🔕 사후학습 — 무시한 딜에 자주 나온 키워드입니다. 정책 패널의 제외 키워드에 추가하면 이 노이즈가 줄어듭니다.' ELSE '알 수 없는 유형(NEW_KIND) — 근거를 그대로 표시합니다.' END) AS reason_chars,
  CASE kind WHEN 'UNCLASSIFIED' THEN t || ' · ' || CASE WHEN len(tags) > 0 THEN '후보: ' || array_to_string(tags, ', ') ELSE '후보 없음' END WHEN 'OUTLIER_LOWER' THEN concat_ws(' · ', s, coalesce(format('{{:,}}', price) || '원', 'null'), {TAGGED}) WHEN 'DEMAND_UNKNOWN' THEN s || ' · ' || t
    WHEN 'KEYWORD_SUGGEST' THEN CASE WHEN len(tags) > 0 THEN '제외 키워드 후보: ' || array_to_string(tags, ', ') ELSE '후보 없음' END ELSE 'item ' || id END AS detail,
  CASE WHEN occurrences = 1 THEN a || ' 접수' ELSE CASE WHEN a = b THEN a ELSE a || ' ~ ' || b END || ' · 같은 항목이 ' || occurrences || '번 다시 쌓였습니다 (수집 파이프라인이 매 주기 재처리합니다)' END AS seen FROM d""")
def review_lines_shown(spark: SparkSession, sf: str) -> DataFrame:
    df = relation(spark, sf, SHOWN.format(none="CAST(array() AS ARRAY<STRING>)", one="array('카할')", two="array('카할', '배송비미상')"))
    c = F.col
    detail = review_lines.detail(c("kind"), c("title"), c("tags"), c("subject"), c("price"), c("tags"), c("tags"), F.concat(F.lit("item "), c("id").cast("string")))
    return df.select("id", F.length(review_lines.reason(c("kind"))).cast("long").alias("reason_chars"), detail.alias("detail"), review_lines.seen_line(c("occurrences"), c("first_seen"), c("last_seen")).alias("seen"))


POLLED = "SELECT p_partkey AS listing_id, p_partkey % 40 AS used_search_id, p_name AS title, CAST(floor(p_retailprice) AS BIGINT) AS price, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'http://x/' || p_partkey % 500 END AS url, CASE WHEN p_size % 3 = 0 THEN 'SOLD' ELSE 'ACTIVE' END AS status FROM part"
ASKED = """SELECT o_orderkey AS request_id, o_orderkey % 45 AS used_search_id, CASE o_orderkey % 3 WHEN 0 THEN 'URL' WHEN 1 THEN 'TEXT' ELSE 'MANUAL' END AS kind, CASE WHEN o_custkey % 4 <> 0 THEN 'red ring ' || o_custkey || {line} || (o_custkey % 300) || '만원 http://y/' || o_orderkey ELSE 'no price' END AS text,
  CASE WHEN o_custkey % 5 = 0 THEN ' ' ELSE 'typed ring' END AS title, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 1500 END AS price, CASE WHEN o_orderkey % 3 = 0 THEN 'http://x/' || o_custkey % 700 END AS url, CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE o_custkey % 50 END AS variant_id FROM orders"""
SOUGHT = "SELECT DISTINCT p_partkey % 40 AS used_search_id, CASE WHEN p_partkey % 40 % 2 = 0 THEN 'BUNJANG' ELSE 'OTHER' END AS platform FROM part"
PRICED = "SELECT p_partkey AS variant_id, CASE WHEN p_size % 6 = 0 THEN 0 ELSE CAST(floor(p_retailprice) AS BIGINT) END AS benchmark_price FROM part WHERE p_partkey < 40"


@registered(f"""WITH l AS ({POLLED}), a AS ({ASKED.format(line="chr(10)")}), s AS ({SOUGHT}), b AS ({PRICED}),
u AS (SELECT used_search_id, url, arg_min(title, listing_id) AS t, arg_min(price, listing_id) AS p FROM l WHERE url IS NOT NULL GROUP BY 1, 2), m AS (SELECT used_search_id, min(price) AS lowest, count(*) AS active FROM l WHERE status = 'ACTIVE' GROUP BY 1),
x AS (SELECT a.request_id, a.kind, a.variant_id, s.platform, m.lowest, coalesce(m.active, 0) AS active, b.benchmark_price AS bench,
    s.platform IS NOT NULL AND CASE a.kind WHEN 'URL' THEN u.t IS NOT NULL WHEN 'TEXT' THEN contains(a.text, '만원') ELSE a.price IS NOT NULL AND trim(a.title) <> '' END AS ok,
    CASE a.kind WHEN 'URL' THEN u.t WHEN 'TEXT' THEN string_split(a.text, chr(10))[1] ELSE trim(a.title) END AS title, CASE a.kind WHEN 'URL' THEN u.p WHEN 'TEXT' THEN TRY_CAST(regexp_extract(a.text, '([0-9]+)만원', 1) AS BIGINT) * 10000 ELSE a.price END AS price, CASE a.kind WHEN 'URL' THEN a.url WHEN 'TEXT' THEN 'http://y/' || a.request_id END AS url
  FROM a LEFT JOIN s USING (used_search_id) LEFT JOIN u ON u.used_search_id = a.used_search_id AND u.url = a.url LEFT JOIN m ON m.used_search_id = a.used_search_id LEFT JOIN b ON b.variant_id = a.variant_id)
SELECT request_id, CASE WHEN platform IS NULL THEN 'UNKNOWN_SEARCH' WHEN ok THEN 'RESOLVED' ELSE 'NEEDS_INPUT' END AS outcome, CASE WHEN platform IS NOT NULL AND NOT ok THEN CASE WHEN kind = 'URL' THEN 'TEXT' ELSE 'MANUAL' END END AS next,
  CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN price END AS price, CASE WHEN ok THEN url END AS url, CASE WHEN ok AND bench > 0 THEN CAST(floor((bench - price) * 100.0 / bench + 0.5) AS BIGINT) END AS percent,
  CASE WHEN ok THEN lowest END AS lowest, CASE WHEN ok THEN active END AS active, CASE WHEN ok THEN CASE WHEN platform = 'BUNJANG' THEN '번개장터' ELSE platform END || ' 활성 매물' END AS source,
  CASE WHEN ok THEN CAST(CASE WHEN contains(title, 'ring') THEN 1 ELSE 0 END + CASE WHEN lowest > 0 AND price <= floor(lowest * 70 / 100) THEN 1 ELSE 0 END AS BIGINT) END AS risks FROM x""")
def evaluated_listings(spark: SparkSession, sf: str) -> DataFrame:
    searches = relation(spark, sf, SOUGHT).withColumn("exclude_keywords", F.array(F.lit("Ri ng")))
    got = evaluate.evaluated(relation(spark, sf, ASKED.format(line="chr(10)")), relation(spark, sf, POLLED), searches, relation(spark, sf, PRICED))
    return got.withColumn("risks", F.when(F.col("outcome") == "RESOLVED", F.size("risks").cast("long")))
