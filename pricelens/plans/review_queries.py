"""Review queue, pins, products, digest and second-hand listings, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions import texts
from pricelens.operators import benchmark, digest, review, used

from .queries import OCCURRED, SNAPS, VIEW, WITH, deals, now, params, registered
from .views import NOW, OBSERVATIONS, relation

ITEMS = """
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'OUTLIER_LOWER' WHEN 1 THEN 'DEMAND_UNKNOWN' WHEN 2 THEN 'UNCLASSIFIED' ELSE 'KEYWORD_SUGGESTION' END AS type, CASE WHEN o_orderstatus = 'P' THEN 'DONE' ELSE 'PENDING' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS deal_event_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'http://post/' || o_orderkey END AS url, o_custkey AS a, o_custkey % 7 AS b, o_orderkey % 9 + 1 AS occurrences, o_orderdate AS last_seen, o_orderkey % 4 AS digest_appearances
FROM orders
"""
SOURCES = "SELECT l_orderkey AS deal_event_id, l_linenumber * 1000000 + l_partkey AS id, 'http://' || l_partkey || '/' || l_linenumber AS url, l_partkey AS post_id FROM lineitem"
PINS = """
SELECT o_orderkey AS pin_id, o_orderkey AS deal_event_id, CASE o_orderstatus WHEN 'P' THEN 'BOUGHT' WHEN 'F' THEN 'MISSED' WHEN 'O' THEN 'ACTIVE' ELSE 'DROPPED' END AS state, o_orderdate AS resolved_at, o_orderkey % 11 = 0 AS revive_unacknowledged
FROM orders WHERE o_orderkey % 2 = 0
"""
PINNED = """
SELECT o_orderkey AS deal_event_id, o_custkey AS variant_id, CASE WHEN o_orderkey % 5 = 0 THEN 'ENDED' ELSE 'ACTIVE' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'LOWER' ELSE 'NONE' END AS outlier_flag, o_orderkey % 13 = 0 AS permanently_excluded, CAST(round(o_totalprice) AS BIGINT) AS price_last
FROM orders
"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, ITEMS).withColumn("candidate_ids", F.when(F.col("type") == "UNCLASSIFIED", F.array("a", "b")))


@registered(f"""WITH q AS ({ITEMS}), s AS (SELECT deal_event_id, arg_min(url, id) AS url FROM ({SOURCES}) GROUP BY 1), d AS ({PINNED})
SELECT id, type, occurrences, last_seen, coalesce(CASE WHEN id % 4 < 2 THEN s.url END, q.url) AS url, CASE WHEN id % 4 < 2 AND d.deal_event_id IS NOT NULL THEN 'variant ' || d.variant_id || ' — ' || d.outlier_flag END AS subject,
  CASE WHEN id % 4 < 2 AND d.status = 'ENDED' THEN 'a,b' END AS tags, CASE WHEN type = 'UNCLASSIFIED' THEN CASE WHEN a % 2 = 0 THEN 'n' || a ELSE '#' || a END || ',' || CASE WHEN b % 2 = 0 THEN 'n' || b ELSE '#' || b END END AS candidates
FROM q LEFT JOIN s USING (deal_event_id) LEFT JOIN d USING (deal_event_id) WHERE q.status = 'PENDING'""")
def pending_queue(spark: SparkSession, sf: str) -> DataFrame:
    conditions = F.when(F.col("status") == "ENDED", F.array(F.lit("b"), F.lit("a"))).otherwise(F.array().cast("array<string>"))
    d = relation(spark, sf, PINNED).select("deal_event_id", F.concat(F.lit("variant "), F.col("variant_id").cast("string")).alias("product_name"), F.col("outlier_flag").alias("label"), conditions.alias("conditions"))
    names = relation(spark, sf, "SELECT c_custkey AS product_id FROM customer").unionByName(spark.range(1).select(F.col("id").alias("product_id"))).distinct().filter("product_id % 2 = 0").select("product_id", F.concat(F.lit("n"), F.col("product_id").cast("string")).alias("name"))
    return review.pending(items(spark, sf), relation(spark, sf, SOURCES), d, names).withColumn("candidates", F.array_join("candidates", ","))


@registered(f"""WITH q AS ({ITEMS}), v AS (SELECT *, CASE id % 5 WHEN 0 THEN 'promote' WHEN 1 THEN 'reject' WHEN 2 THEN 'other' END AS verb FROM q)
SELECT id, CASE WHEN status = 'PENDING' AND verb = 'promote' THEN 'RESOLVED' WHEN status = 'PENDING' AND verb = 'reject' THEN 'DISMISSED' ELSE status END AS status,
  CASE WHEN status = 'PENDING' AND verb IN ('promote', 'reject') THEN CASE WHEN type = 'OUTLIER_LOWER' AND verb = 'promote' THEN 'CLEAR_FLAG' WHEN type = 'OUTLIER_LOWER' THEN 'EXCLUDE' WHEN type = 'UNCLASSIFIED' AND verb = 'promote' THEN 'LEARN_ALIAS' END END AS effect FROM v""")
def resolved_items(spark: SparkSession, sf: str) -> DataFrame:
    verb = F.when(F.col("id") % 5 == 0, "promote").when(F.col("id") % 5 == 1, "reject").otherwise("other")
    q = items(spark, sf)
    return review.resolved(q, q.filter("id % 5 < 3").select("id", verb.alias("verb")))


@registered(f"SELECT deal_event_id, CASE WHEN deal_event_id % 3 = 0 THEN 'NONE' ELSE outlier_flag END AS outlier_flag, permanently_excluded OR deal_event_id % 3 = 1 AS permanently_excluded FROM ({PINNED})")
def judged_outliers(spark: SparkSession, sf: str) -> DataFrame:
    d = relation(spark, sf, PINNED)
    effects = d.filter("deal_event_id % 3 < 2").select("deal_event_id", F.when(F.col("deal_event_id") % 3 == 0, "CLEAR_FLAG").otherwise("EXCLUDE").alias("effect"))
    return review.promoted(d, effects).select("deal_event_id", "outlier_flag", "permanently_excluded")


@registered("""SELECT event_id, CASE WHEN user_id % 3 = 0 AND event_id % 4 < 2 THEN CASE event_id % 4 WHEN 0 THEN 'promote' ELSE 'reject' END END AS verb, CASE WHEN user_id % 3 = 0 AND event_id % 4 < 2 THEN event_id END AS id FROM events""")
def button_presses(spark: SparkSession, sf: str) -> DataFrame:
    """Buttons of four kinds: two that are known, one with a broken number, one with an unknown verb; from an allowed chat every third time."""
    sql = "SELECT event_id, user_id % 3 AS chat, CASE event_id % 4 WHEN 0 THEN 'promote:' || event_id WHEN 1 THEN 'reject:' || event_id WHEN 2 THEN 'promote:x' || event_id ELSE 'drop:' || event_id END AS data FROM events"
    return relation(spark, sf, sql).select("event_id", review.callback(F.col("data"), F.col("chat"), [0]).alias("c")).select("event_id", "c.verb", "c.id")


@registered(f"SELECT id, digest_appearances + CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END AS digest_appearances FROM ({ITEMS})")
def shown_items(spark: SparkSession, sf: str) -> DataFrame:
    q = items(spark, sf)
    ids = q.filter("id % 6 = 0").select("id")
    return review.shown(q, ids.unionByName(ids)).select("id", "digest_appearances")


@registered(f"""WITH d AS ({PINNED}), p AS ({PINS}), s AS (SELECT deal_event_id, arg_min(post_id, id) AS anchor_post_id FROM ({SOURCES}) GROUP BY 1)
SELECT d.deal_event_id, anchor_post_id FROM d LEFT JOIN s USING (deal_event_id) WHERE status <> 'ENDED' AND outlier_flag = 'NONE' AND NOT permanently_excluded AND d.deal_event_id NOT IN (SELECT deal_event_id FROM p WHERE state = 'ACTIVE')""")
def new_pins(spark: SparkSession, sf: str) -> DataFrame:
    d = relation(spark, sf, PINNED)
    return review.pin(d, d, relation(spark, sf, PINS), relation(spark, sf, SOURCES))


@registered(f"""WITH d AS ({PINNED}), p AS ({PINS}) SELECT pin_id, CASE WHEN state = 'ACTIVE' THEN 'ACTIVE' ELSE 'RESOLVED' END AS section, state = 'ACTIVE' AND coalesce(status = 'ENDED', false) AS missed, state = 'ACTIVE' AND revive_unacknowledged AS revived, price_last AS price FROM p LEFT JOIN d USING (deal_event_id)""")
def watch_list(spark: SparkSession, sf: str) -> DataFrame:
    return review.watch_list(relation(spark, sf, PINS), relation(spark, sf, PINNED))


@registered(f"WITH d AS ({PINNED}), p AS ({PINS}) SELECT pin_id, variant_id, price_last AS price, status AS conditions FROM p LEFT JOIN d USING (deal_event_id)")
def bought_prefill(spark: SparkSession, sf: str) -> DataFrame:
    d = relation(spark, sf, PINNED).withColumn("conditions", F.col("status"))
    return review.bought_prefill(relation(spark, sf, PINS), d)


@registered(f"""WITH p AS ({PINS}) SELECT pin_id, ((state = 'ACTIVE' AND deal_event_id % 4 = 0) OR revive_unacknowledged) AND pin_id % 6 <> 0 AS revive_unacknowledged FROM p""")
def revived_pins(spark: SparkSession, sf: str) -> DataFrame:
    p = relation(spark, sf, PINS)
    return review.revived(p, p.filter("deal_event_id % 4 = 0"), p.filter("pin_id % 6 = 0"))


@registered("SELECT p_size AS rank, count(*) AS n FROM part WHERE p_size % 4 = 0 GROUP BY 1 HAVING count(*) > 1")
def repeated_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return review.repeated_ranks(relation(spark, sf, "SELECT CASE WHEN p_size % 4 = 0 THEN p_size END AS rank FROM part"))


@registered("""SELECT min(p_partkey) AS product_id, p_name AS name, CASE WHEN min(p_partkey) % 3 = 0 THEN '' ELSE 'size,type' END AS axes, array_to_string(list_sort(list(DISTINCT CAST(p_size AS VARCHAR))), ',') AS variants FROM part GROUP BY p_name HAVING min(p_partkey) % 5 <> 0""")
def product_summaries(spark: SparkSession, sf: str) -> DataFrame:
    products = relation(spark, sf, "SELECT min(p_partkey) AS product_id, p_name AS name, min(p_partkey) % 5 = 0 AS archived FROM part GROUP BY p_name")
    axes = products.filter("product_id % 3 <> 0").select("product_id", F.explode(F.array(F.lit("type"), F.lit("size"))).alias("name"))
    variants = relation(spark, sf, "SELECT DISTINCT p_name AS name, CAST(p_size AS VARCHAR(9)) AS label FROM part").join(products, "name").select("product_id", "label")
    got = review.product_summaries(products, axes, variants)
    return got.withColumn("axes", F.array_join("axes", ",")).withColumn("variants", F.array_join("variants", ","))


@registered("SELECT DISTINCT p_size AS product_id, p_type AS name FROM part WHERE p_size % 2 = 1 OR p_type NOT IN ('PROMO', 'STANDARD')")
def missing_axes(spark: SparkSession, sf: str) -> DataFrame:
    wanted = relation(spark, sf, "SELECT p_size AS product_id, p_type AS name FROM part")
    return review.missing_axes(wanted, wanted.filter("product_id % 2 = 0 AND name IN ('PROMO', 'STANDARD')"))


#: Posts as they were, and as a later poll saw them: prices move, a posting time once known stays.
@registered("""WITH o AS (SELECT o_orderkey AS post_id, CAST(round(o_totalprice) AS BIGINT) AS price, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS posted_at FROM orders WHERE o_orderkey % 4 <> 0),
n AS (SELECT o_orderkey AS post_id, CAST(round(o_totalprice) AS BIGINT) + 1 AS price, o_orderdate + INTERVAL 1 DAY AS posted_at FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(o.post_id, n.post_id) AS post_id, coalesce(n.price, o.price) AS price, coalesce(o.posted_at, n.posted_at) AS posted_at FROM o FULL JOIN n USING (post_id)""".replace("coalesce(o.post_id, n.post_id) AS post_id", "post_id"))
def upserted_posts(spark: SparkSession, sf: str) -> DataFrame:
    old = relation(spark, sf, "SELECT o_orderkey AS post_id, CAST(round(o_totalprice) AS BIGINT) AS price, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS posted_at FROM orders WHERE o_orderkey % 4 <> 0")
    new = relation(spark, sf, "SELECT o_orderkey AS post_id, CAST(round(o_totalprice) AS BIGINT) AS price, o_orderdate + INTERVAL '1' DAY AS posted_at FROM orders WHERE o_orderkey % 5 <> 0")
    twice = new.withColumn("at", F.lit(1)).unionByName(new.withColumn("price", F.col("price") + 1).withColumn("at", F.lit(2)))
    return review.upserted(old, twice, ["post_id"], "at", keep=("posted_at",))


STATES = f"SELECT p_partkey AS variant_id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE TIMESTAMP '2001-01-01 00:00:00' + p_size * INTERVAL '1' DAY END AS last_sent_at, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 < 3 THEN 'GRAY' ELSE 'RED' END AS stored_color, TIMESTAMP '2000-12-01 00:00:00' + (p_partkey % 60) * INTERVAL '1' DAY AS created_at, CASE WHEN p_size % 3 = 0 THEN 'SPLIT' ELSE 'GROUPED' END AS demand_axis_mode FROM part"
FLOWS = f"""st AS ({STATES}), fl AS (SELECT st.variant_id, count(deal_event_id) FILTER (first_seen >= greatest(created_at, last_sent_at)) AS in_window, count(deal_event_id) AS ever, min(CASE WHEN status = 'ENDED' THEN price_min ELSE price_last END) FILTER (first_seen >= greatest(created_at, last_sent_at)) AS best
  FROM st LEFT JOIN (SELECT * FROM deals WHERE {OCCURRED} AND first_seen < {NOW}) d USING (variant_id) GROUP BY 1)"""
MOVES = VIEW + f""", l AS (SELECT variant_id, min(price_last) AS best FROM deals WHERE NOT unclassified AND outlier_flag = 'NONE' AND status <> 'ENDED' AND last_seen >= {NOW} - INTERVAL 7 DAY GROUP BY 1),
sg AS (SELECT variant_id, CASE WHEN tier <> 'SUFFICIENT' THEN 'GRAY' WHEN best IS NULL THEN 'RED' WHEN best <= good_deal_line THEN 'GREEN' WHEN best <= benchmark_price THEN 'YELLOW' ELSE 'RED' END AS color FROM view LEFT JOIN l USING (variant_id)),
{FLOWS}, mv AS (SELECT variant_id, stored_color AS was, CASE WHEN demand_axis_mode <> 'SPLIT' THEN color END AS now, coalesce(stored_color <> CASE WHEN demand_axis_mode <> 'SPLIT' THEN color END, false) AS reportable FROM sg JOIN st USING (variant_id))"""


def states(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, STATES.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))


def flows(spark: SparkSession, sf: str) -> DataFrame:
    s = states(spark, sf)
    return digest.opportunities(deals(spark, sf), digest.windows(s.select("variant_id", "created_at"), s), now())


def signals(spark: SparkSession, sf: str) -> DataFrame:
    d = deals(spark, sf)
    return benchmark.signal(d, benchmark.benchmark(d, params(spark, sf), now()), now())


def moves(spark: SparkSession, sf: str) -> DataFrame:
    s = states(spark, sf)
    return digest.transitions(signals(spark, sf), s, s.select("variant_id", "demand_axis_mode"))


@registered(f"{WITH}, {FLOWS} SELECT * FROM fl")
def digest_flows(spark: SparkSession, sf: str) -> DataFrame:
    return flows(spark, sf)


@registered(MOVES + "SELECT * FROM mv")
def digest_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return moves(spark, sf)


@registered(f"""WITH p AS ({PINS}) SELECT deal_event_id, state AS event, resolved_at AS at FROM p WHERE state IN ('BOUGHT', 'MISSED') AND resolved_at >= TIMESTAMP '1998-01-01 00:00:00' AND resolved_at < TIMESTAMP '1998-03-01 00:00:00'
UNION ALL SELECT o_orderkey, 'REVIVED', o_orderdate FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-03-01 00:00:00'""")
def digest_pins(spark: SparkSession, sf: str) -> DataFrame:
    sent = relation(spark, sf, "SELECT o_orderkey AS deal_event_id, CASE WHEN o_orderkey % 3 = 0 THEN 'REOPENED' ELSE 'FIRST' END AS kind, o_orderdate AS sent_at FROM orders")
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return digest.pin_events(relation(spark, sf, PINS), sent, at("1998-01-01"), at("1998-03-01"))


@registered(MOVES + "SELECT NOT ((SELECT bool_or(in_window > 0) FROM fl) OR (SELECT bool_or(reportable) FROM mv)) AS quiet")
def quiet_week(spark: SparkSession, sf: str) -> DataFrame:
    return digest.quiet_week(flows(spark, sf), moves(spark, sf))


@registered(MOVES + """, ln AS (SELECT variant_id, concat_ws(' · ', CASE WHEN in_window > 0 THEN in_window || '건 (최저 ' || format('{:,}', best) || '원)' END, CASE WHEN reportable THEN was || ' → ' || now END) AS said FROM fl LEFT JOIN mv USING (variant_id))
SELECT variant_id, p_name || ': ' || said AS line FROM ln JOIN part ON p_partkey = variant_id WHERE said <> ''""")
def digest_lines(spark: SparkSession, sf: str) -> DataFrame:
    return digest.lines(flows(spark, sf), moves(spark, sf), relation(spark, sf, "SELECT p_partkey AS variant_id, p_name AS name FROM part"))


@registered(MOVES + f"SELECT variant_id, {NOW} AS last_sent_at, color AS stored_color FROM sg JOIN st USING (variant_id)")
def digest_sent(spark: SparkSession, sf: str) -> DataFrame:
    return digest.bookkeeping(states(spark, sf), signals(spark, sf), spark.createDataFrame([(True,), (True,)], "sent boolean"), now())


@registered(SNAPS + """, l AS (SELECT used_search_id, max(batch) AS latest FROM s GROUP BY 1) SELECT used_search_id, listing_id, CASE WHEN max(batch) = any_value(latest) THEN 'ACTIVE' ELSE 'SOLD' END AS status, arg_max(price, batch) AS price, min(batch) AS first_seen, max(batch) AS last_seen FROM s JOIN l USING (used_search_id) GROUP BY 1, 2""")
def listing_states(spark: SparkSession, sf: str) -> DataFrame:
    return used.listing_state(relation(spark, sf, OBSERVATIONS))


@registered(f"WITH o AS ({OBSERVATIONS}) SELECT DISTINCT used_search_id, batch FROM o WHERE used_search_id % 2 = 0 OR batch > DATE '2024-01-05'")
def unfolded_batches(spark: SparkSession, sf: str) -> DataFrame:
    searches = spark.range(10).select(F.col("id").alias("used_search_id"), F.when(F.col("id") % 2 == 1, F.lit("2024-01-05").cast("date")).alias("listings_folded_through"))
    return used.unfolded_batches(relation(spark, sf, OBSERVATIONS), searches)


LISTED = """
SELECT p_partkey AS listing_id, p_partkey % 3 AS k, p_name || ' ' || p_size || '만원' || chr(10) || 'http://x/' || p_partkey || ' ' || CAST(floor(p_retailprice) AS BIGINT) || '원 ' || p_size || ' ' AS text, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE ' ' || p_name || ' ' END AS title, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS BIGINT) END AS price, p_name, p_size, CAST(floor(p_retailprice) AS BIGINT) AS r
FROM part
"""


@registered(f"""SELECT listing_id, CASE k WHEN 0 THEN CASE WHEN price IS NOT NULL AND trim(title) <> '' THEN trim(title) END WHEN 1 THEN p_name || ' ' || p_size || '만원' END AS title,
  CASE k WHEN 0 THEN CASE WHEN trim(title) <> '' THEN price END WHEN 1 THEN greatest(p_size * 10000, r) END AS price, CASE WHEN k = 1 THEN 'http://x/' || listing_id END AS url, CASE WHEN k = 2 THEN 'TEXT' ELSE 'MANUAL' END AS next FROM ({LISTED})""")
def extracted_listings(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.get(F.array(F.lit("MANUAL"), F.lit("TEXT"), F.lit("URL")), F.col("k").cast("int"))
    got = used.extracted(kind, F.col("text"), F.col("title"), F.col("price"), F.lit(None).cast("string"))
    return relation(spark, sf, LISTED).select("listing_id", got.alias("x"), used.fallback(kind).alias("next")).select("listing_id", "x.title", "x.price", "x.url", "next")


@registered("""WITH l AS (SELECT p_type, min(CAST(floor(p_retailprice) AS BIGINT)) AS low FROM part GROUP BY 1)
SELECT p_partkey AS listing_id, concat_ws(';', CASE WHEN contains(lower(replace(p_name, ' ', '')), 'ring') THEN '업자 레퍼토리 키워드=Ri ng' END, CASE WHEN contains(lower(replace(p_name, ' ', '')), 'gear') THEN '업자 레퍼토리 키워드=GEAR' END, CASE WHEN CAST(floor(p_retailprice) AS BIGINT) - 400 <= low * 70 // 100 THEN '가격 이상=스냅샷 최저 대비 30% 이상 저렴' END) AS risks FROM part JOIN l USING (p_type)""")
def listing_risks(spark: SparkSession, sf: str) -> DataFrame:
    part = relation(spark, sf, "SELECT p_partkey AS listing_id, p_name, p_type, CAST(floor(p_retailprice) AS BIGINT) AS price FROM part")
    df = part.join(part.groupBy("p_type").agg(F.min("price").alias("low")), "p_type")
    risks = used.risk_signals(F.col("p_name"), F.array(F.lit("Ri ng"), F.lit("GEAR")), F.col("price") - 400, F.col("low"), 30)
    return df.select("listing_id", F.array_join(F.transform(risks, lambda r: F.concat(r["category"], F.lit("="), r["detail"])), ";").alias("risks"))


@registered("""SELECT p_partkey AS listing_id FROM part WHERE p_size % 2 = 0 AND p_size % 3 = 0 AND (p_partkey % 4 = 0 OR p_retailprice <= 1400)""")
def used_alerts(spark: SparkSession, sf: str) -> DataFrame:
    part = relation(spark, sf, "SELECT p_partkey AS listing_id, p_size % 2 = 0 AS candidate, p_size % 3 = 0 AS triggered, p_retailprice AS price, CASE WHEN p_partkey % 4 <> 0 THEN 1400 END AS target_price FROM part")
    return used.new_alerts(part).select("listing_id")


@registered("""WITH e AS (SELECT p_partkey AS listing_id, CASE p_partkey % 3 WHEN 0 THEN 'PRICE' WHEN 1 THEN 'SOLD' ELSE 'NEW' END AS event, p_size % 2 = 0 AS promoted, p_size AS was, p_partkey % 50 AS price, p_name FROM part)
SELECT listing_id, CASE WHEN event = 'SOLD' THEN '⛔ 중고 매물 소실 (판매완료 추정 — 원문 확인 필요)' || chr(10) || '대상 미상' || chr(10) || p_name || chr(10) || price || '원' ELSE '📉 중고 가격 하락' || chr(10) || '대상 미상' || chr(10) || p_name || chr(10) || was || '원 → ' || price || '원' END AS message
FROM e WHERE promoted AND (event = 'SOLD' OR (event = 'PRICE' AND price < was))""")
def used_messages(spark: SparkSession, sf: str) -> DataFrame:
    e = relation(spark, sf, "SELECT p_partkey AS listing_id, CASE p_partkey % 3 WHEN 0 THEN 'PRICE' WHEN 1 THEN 'SOLD' ELSE 'NEW' END AS event, p_size % 2 = 0 AS promoted, p_size AS was, p_partkey % 50 AS price, p_name AS title FROM part")
    return used.promoted_alerts(e).select("listing_id", texts.used_message(F.col("kind"), F.lit(None).cast("string"), F.col("title"), F.col("was"), F.col("price"), F.lit(None).cast("string")).alias("message"))
