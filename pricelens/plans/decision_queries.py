"""Benchmarks as asked for, alerts from decision to delivery, purchases: with DuckDB SQL written from the model's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.operators import alerts, benchmark, matching, polls, purchases, titles

from .queries import BOUGHT, DECIDED, VIEW, WITH, deals, now, params, registered
from .views import DEALS, NOW, POLLS, PURCHASES, relation


@registered(VIEW + f"SELECT s.variant_id, s.deal_event_id, s.price_first, s.first_seen FROM b s JOIN view USING (variant_id) WHERE tier = 'SPARSE'")
def sparse_cases(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark.sparse_cases(deals(spark, sf), params(spark, sf), now())


@registered(VIEW + f"""SELECT d.variant_id, d.deal_event_id, d.price_first, d.outlier_flag FROM deals d JOIN params p USING (variant_id) LEFT JOIN e USING (variant_id)
WHERE d.outlier_flag <> 'NONE' AND d.first_seen BETWEEN {NOW} - to_months(CAST(coalesce(e.eff, p.period_months) AS INTEGER)) AND {NOW}""")
def outlier_listing(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark.outlier_listing(deals(spark, sf), params(spark, sf), now())


#: The benchmark as a user asks for it: without deals of an excluded keyword, and of split products those of one demand value.
ASKED = f"SELECT x.* FROM ({DEALS}) x JOIN part ON variant_id = p_partkey WHERE NOT contains(p_name, 'gear') AND NOT (variant_id % 7 = 0 AND contains(p_name, 'ring')) AND (p_size % 3 <> 0 OR demand_axis_value = 'STANDARD')"


@registered(VIEW.replace(f"deals AS ({DEALS})", f"deals AS ({ASKED})") + "SELECT variant_id, tier, n, m, benchmark_price, good_deal_line, period_lowest, expanded_to_months, lowest_case FROM view")
def asked_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    d = deals(spark, sf)
    named = relation(spark, sf, "SELECT p_partkey AS variant_id, p_name AS title, CASE WHEN p_size % 3 = 0 THEN 'SPLIT' ELSE 'GROUPED' END AS demand_axis_mode FROM part")
    posts = d.select(F.col("deal_event_id").alias("deal_id"), "variant_id").join(named.select("variant_id", "title"), "variant_id").select("deal_id", "title")
    words = spark.createDataFrame([(None, "gear")], "variant_id long, keyword string").unionByName(named.filter("variant_id % 7 = 0").select("variant_id", F.lit("ring").alias("keyword")))
    kept = titles.exclude_keywords(d.withColumnRenamed("deal_event_id", "deal_id"), posts, words).withColumnRenamed("deal_id", "deal_event_id")
    scoped = matching.demand_scope(kept, named.select("variant_id", "demand_axis_mode"), F.lit("STANDARD"))
    return benchmark.benchmark(scoped, params(spark, sf), now()).select("variant_id", "tier", "n", "m", "benchmark_price", "good_deal_line", "period_lowest", "expanded_to_months", "lowest_case")


@registered(VIEW + f""", l AS (SELECT variant_id, first(price_last ORDER BY price_last, deal_event_id) AS best, first(epoch_us({NOW}) - epoch_us(last_seen) ORDER BY price_last, deal_event_id) AS stale
  FROM deals WHERE NOT unclassified AND outlier_flag = 'NONE' AND status <> 'ENDED' AND last_seen >= {NOW} - INTERVAL 7 DAY GROUP BY 1)
SELECT variant_id, CASE WHEN tier <> 'SUFFICIENT' THEN 'GRAY' WHEN best IS NULL THEN 'RED' WHEN best <= good_deal_line THEN 'GREEN' WHEN best <= benchmark_price THEN 'YELLOW' ELSE 'RED' END AS color,
  concat_ws('; ', CASE WHEN tier = 'SUFFICIENT' AND good_deal_line IS NULL THEN '굿딜라인 미확립' END, CASE WHEN tier = 'SUFFICIENT' AND stale > 48 * 3600000000 THEN '신선도 약화' END, CASE WHEN variant_id % 4 = 0 AND variant_id % 3 > 0 THEN '제외 키워드로 ' || variant_id % 3 || '건 제외' END) AS notes
FROM view LEFT JOIN l USING (variant_id)""")
def signal_notes(spark: SparkSession, sf: str) -> DataFrame:
    d, p = deals(spark, sf), params(spark, sf)
    excluded = p.filter("variant_id % 4 = 0").select("variant_id", (F.col("variant_id") % 3).alias("n"))
    got = benchmark.signal_notes(benchmark.signal(d, benchmark.benchmark(d, p, now()), now()), excluded, F.lit(True))
    return got.withColumn("notes", F.array_join("notes", "; "))


@registered(f"""WITH p AS ({POLLS}), l AS (SELECT *, coalesce(max(outcome = 'BLOCKED') OVER (PARTITION BY site ORDER BY seen_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM p)
SELECT min(last_ok) AS at, true AS measured FROM (SELECT site, max(seen_at) AS last_ok FROM l WHERE NOT over AND outcome = 'OK' GROUP BY 1)""")
def observation_clock(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark.observation_clock(polls.cursors(relation(spark, sf, POLLS)), now())


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Those of deals whose demand value may alert: split products need one, and every fifth variant wants STANDARD or PROMO only."""
    d, p = deals(spark, sf), params(spark, sf)
    mode = F.when(F.col("variant_id") % 6 == 0, "SPLIT").otherwise("GROUPED")
    wanted = F.when(F.col("variant_id") % 5 == 0, F.array(F.lit("STANDARD"), F.lit("PROMO"))).otherwise(F.array().cast("array<string>"))
    value = F.when(F.col("variant_id") % 12 != 0, F.col("demand_axis_value"))
    open_ = d.filter(alerts.axis_open(value, wanted, mode))
    return alerts.alert_decisions(open_, benchmark.benchmark(d, p, now()), p.select("variant_id", "target_price", "quiet_start", "quiet_end"), F.lit(8), relation(spark, sf, BOUGHT))


OPEN = DECIDED + """, open AS (SELECT * FROM decided WHERE (variant_id % 5 <> 0 OR coalesce(CASE WHEN variant_id % 12 <> 0 THEN demand_axis_value END IN ('STANDARD', 'PROMO'), false)) AND NOT (variant_id % 6 = 0 AND variant_id % 12 = 0))"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier alerts: FIRST of deals of every fifth variant, ENDED of every tenth."""
    d = deals(spark, sf)
    first = d.filter("variant_id % 5 = 1").select("deal_event_id", F.lit("FIRST").alias("kind"))
    return first.unionByName(d.filter("variant_id % 10 = 1").select("deal_event_id", F.lit("ENDED").alias("kind")))


@registered(OPEN + """SELECT deal_event_id, coalesce(outcome, 'NO_ALERT') AS outcome, coalesce(outcome = 'SENT', false) AND d.variant_id % 5 <> 1 AS log_first, coalesce(outcome = 'HELD', false) AND d.variant_id % 3 <> 0 AS hold FROM deals d LEFT JOIN open USING (deal_event_id)""")
def dispatch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    d = deals(spark, sf)
    return alerts.dispatched(d, decisions(spark, sf), log(spark, sf), d.filter("variant_id % 3 = 0").select("deal_event_id"))


@registered(f"""{WITH} SELECT deal_event_id, kind FROM deals, (VALUES ('ENDED', 'ENDED'), ('VERIFIED', 'VERIFIED'), ('ACTIVE', 'PINNED_PRICE_INCREASED')) k(status_, kind)
WHERE status = status_ AND (variant_id % 5 = 1 OR kind = 'PINNED_PRICE_INCREASED') AND NOT (variant_id % 10 = 1 AND kind = 'ENDED') AND variant_id % 8 <> 0""")
def follow_ups(spark: SparkSession, sf: str) -> DataFrame:
    """Deals that ended, were verified, or - active ones - got dearer while pinned; those of every eighth variant are gone."""
    d = deals(spark, sf)
    kind = F.when(F.col("status") == "ENDED", "ENDED").when(F.col("status") == "VERIFIED", "VERIFIED").otherwise(alerts.UNPROMPTED)
    return alerts.follow_ups(d.select("deal_event_id", kind.alias("kind")), log(spark, sf), d.filter("variant_id % 8 <> 0"))


@registered(OPEN + """SELECT deal_event_id, CASE WHEN coalesce(quiet_start <> quiet_end AND CASE WHEN quiet_start < quiet_end THEN 8 >= quiet_start AND 8 < quiet_end ELSE 8 >= quiet_start OR 8 < quiet_end END, false) THEN 'WAITING' WHEN outcome = 'SENT' THEN 'SENT' ELSE 'DROPPED' END AS result
FROM deals d LEFT JOIN params p USING (variant_id) LEFT JOIN open USING (deal_event_id) WHERE d.variant_id % 3 = 0""")
def flushed_alerts(spark: SparkSession, sf: str) -> DataFrame:
    held = deals(spark, sf).filter("variant_id % 3 = 0").select("deal_event_id", "variant_id")
    return alerts.flushed(held, params(spark, sf), decisions(spark, sf), F.lit(8))


@registered(f"""WITH p AS ({BOUGHT}) SELECT variant_id, concat_ws(',', CASE WHEN bool_or(state <> 'ARCHIVED') THEN 'JACKPOT' END, CASE WHEN bool_or(state <> 'ARCHIVED') THEN 'TARGET' END, CASE WHEN bool_or(state = 'OBSERVING') THEN 'PAID_PRICE' END, CASE WHEN bool_or(state = 'CLOSED') THEN 'RELATIVE' END) AS enabled FROM p GROUP BY 1""")
def enabled_triggers(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.enabled_triggers(relation(spark, sf, BOUGHT)).withColumn("enabled", F.array_join("enabled", ","))


@registered(f"""{WITH}, o AS (SELECT variant_id, min(first_seen) AS since FROM deals GROUP BY 1), due AS (SELECT * FROM purchases WHERE state = 'REPORT_PENDING' AND {NOW} >= purchased_at + to_days(CAST(observation_days AS INTEGER)) AND purchase_id % 4 <> 0)
SELECT purchase_id, coalesce(any_value(purchased_at) < any_value(since), false) AS unobserved, CASE WHEN coalesce(any_value(purchased_at) < any_value(since), false) THEN 0 ELSE count(deal_event_id) END AS n
FROM due p LEFT JOIN o USING (variant_id) LEFT JOIN deals d ON d.variant_id = p.variant_id AND NOT unclassified AND outlier_flag = 'NONE' AND NOT permanently_excluded AND NOT shipping_unknown AND NOT free_price AND first_seen BETWEEN purchased_at AND purchased_at + to_days(CAST(observation_days AS INTEGER)) GROUP BY 1""")
def issued_cards(spark: SparkSession, sf: str) -> DataFrame:
    p = relation(spark, sf, PURCHASES)
    return purchases.issued_cards(p, deals(spark, sf), p.filter("purchase_id % 4 = 0").select("purchase_id"), now()).select("purchase_id", "unobserved", "n")


@registered(f"""WITH p AS ({BOUGHT}), m AS (SELECT purchase_id, state, ['OBSERVING', 'REPORT_PENDING', 'CLOSED', 'ARCHIVED'][1 + purchase_id % 4] AS target FROM p)
SELECT purchase_id, (state, target) IN (('OBSERVING', 'REPORT_PENDING'), ('REPORT_PENDING', 'CLOSED'), ('CLOSED', 'ARCHIVED'), ('ARCHIVED', 'OBSERVING')) AS ok FROM m""")
def purchase_moves(spark: SparkSession, sf: str) -> DataFrame:
    target = F.get(F.array(*(F.lit(s) for s in ("OBSERVING", "REPORT_PENDING", "CLOSED", "ARCHIVED"))), (F.col("purchase_id") % 4).cast("int"))
    return purchases.transitions(relation(spark, sf, BOUGHT).withColumn("target", target), purchases.PURCHASE_MOVES).select("purchase_id", "ok")


@registered(f"""{WITH} SELECT deal_event_id, (status, target) IN (('ACTIVE', 'VERIFIED'), ('ACTIVE', 'ENDED'), ('VERIFIED', 'ENDED'), ('ENDED', 'ACTIVE')) AS ok FROM (SELECT *, ['ACTIVE', 'VERIFIED', 'ENDED'][1 + variant_id % 3] AS target FROM deals)""")
def deal_moves(spark: SparkSession, sf: str) -> DataFrame:
    target = F.get(F.array(*(F.lit(s) for s in ("ACTIVE", "VERIFIED", "ENDED"))), (F.col("variant_id") % 3).cast("int"))
    return purchases.transitions(deals(spark, sf).select("deal_event_id", F.col("status").alias("state"), target.alias("target")), purchases.DEAL_MOVES).select("deal_event_id", "ok")
