"""Queries for the deal operators over the driver's tables, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions.numbers import used_percent
from pricelens.operators import alerts, benchmark, dealsets, outliers, polls, purchases, used

from .views import DEALS, NOW, OBSERVATIONS, PARAMS, POLLS, PURCHASES, relation

QUERIES = {}
SQL = {}


def registered(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def now() -> Column:
    return F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


def deals(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, DEALS)


def params(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, PARAMS)


WITH = f"WITH deals AS ({DEALS}), params AS ({PARAMS}), purchases AS ({PURCHASES})"
PRICING = "NOT unclassified AND outlier_flag = 'NONE' AND NOT permanently_excluded AND NOT shipping_unknown AND NOT free_price"
OCCURRED = "NOT unclassified AND outlier_flag <> 'UPPER' AND NOT (outlier_flag = 'LOWER' AND permanently_excluded)"
ON = "NOT unclassified AND outlier_flag = 'NONE' AND status <> 'ENDED'"
#: The window grows month by month: the loop, written out as the least width that is enough or holds all there is.
VIEW = f"""{WITH}, s AS (SELECT * FROM deals WHERE {PRICING} AND first_seen <= {NOW}),
w AS (SELECT p.variant_id, p.period_months, p.k_display, m.m, count(s.deal_event_id) AS held FROM params p CROSS JOIN range(1, 13) m(m)
  JOIN s ON s.variant_id = p.variant_id AND s.first_seen >= {NOW} - to_months(CAST(m.m AS INTEGER)) WHERE m.m >= p.period_months GROUP BY ALL),
e AS (SELECT variant_id, min(m) AS eff FROM (SELECT *, max(held) OVER (PARTITION BY variant_id) AS most FROM w) WHERE held >= greatest(k_display + 2, 7) OR held = most GROUP BY 1),
-- widths without any deal have no row above; a sample that only a wider window holds starts there
b AS (SELECT s.*, e.eff FROM s JOIN e USING (variant_id) WHERE s.first_seen >= {NOW} - to_months(CAST(e.eff AS INTEGER))),
g AS (SELECT variant_id, any_value(eff) AS eff, count(*) AS n, count(*) FILTER (n_sites >= 2) AS m, CAST(round(quantile_cont(price_first, 0.5)) AS BIGINT) AS med,
  CAST(round(quantile_cont(price_first, 0.25) FILTER (n_sites >= 2)) AS BIGINT) AS p25, min(price_first) FILTER (n_sites >= 2) AS low, min(price_first) AS least,
  first(price_first ORDER BY first_seen DESC, deal_event_id) AS latest FROM b GROUP BY 1),
t AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(m, 0) AS m, med, p25, low, least, latest, eff, CASE WHEN coalesce(n, 0) = 0 THEN 'NONE' WHEN n >= k_display THEN 'SUFFICIENT' ELSE 'SPARSE' END AS tier FROM params p LEFT JOIN g USING (variant_id)),
view AS (SELECT variant_id, tier, n, m, CASE WHEN tier = 'SUFFICIENT' THEN med END AS benchmark_price, CASE WHEN tier = 'SUFFICIENT' THEN p25 END AS good_deal_line, CASE WHEN tier = 'SUFFICIENT' THEN low END AS period_lowest,
  CAST(CASE WHEN eff > period_months THEN eff END AS INTEGER) AS expanded_to_months, latest AS latest_price, current_price, CASE WHEN tier = 'SPARSE' THEN least END AS lowest_case FROM t)
"""


@registered(VIEW + """SELECT *, current_price - benchmark_price AS gap_won,
  CAST(round(CAST((current_price - benchmark_price) * 100 AS DECIMAL(20, 0)) / benchmark_price, 1) AS DECIMAL(12, 1)) AS gap_pct, current_price - period_lowest AS gap_lowest_won,
  CAST(round(CAST((current_price - period_lowest) * 100 AS DECIMAL(20, 0)) / period_lowest, 1) AS DECIMAL(12, 1)) AS gap_lowest_pct FROM view""")
def benchmark_view(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark.benchmark(deals(spark, sf), params(spark, sf), now())


@registered(VIEW + f""", l AS (SELECT variant_id, first(price_last ORDER BY price_last, deal_event_id) AS best, first(epoch_us({NOW}) - epoch_us(last_seen) ORDER BY price_last, deal_event_id) AS stale
  FROM deals WHERE {ON} AND last_seen >= {NOW} - INTERVAL 7 DAY GROUP BY 1)
SELECT variant_id, CASE WHEN tier <> 'SUFFICIENT' THEN 'GRAY' WHEN best IS NULL THEN 'RED' WHEN best <= good_deal_line THEN 'GREEN' WHEN best <= benchmark_price THEN 'YELLOW' ELSE 'RED' END AS color,
  good_deal_line IS NOT NULL AS established, CASE WHEN tier = 'SUFFICIENT' THEN best END AS best_price, coalesce(tier = 'SUFFICIENT' AND stale > 48 * 3600000000, false) AS weakened
FROM view LEFT JOIN l USING (variant_id)""")
def signal_view(spark: SparkSession, sf: str) -> DataFrame:
    d = deals(spark, sf)
    return benchmark.signal(d, benchmark.benchmark(d, params(spark, sf), now()), now())


@registered(f"""{WITH}, o AS (SELECT variant_id, min(first_seen) AS since FROM deals GROUP BY 1),
s AS (SELECT variant_id, first_seen, since, first_seen >= {NOW} - INTERVAL 6 MONTH AS inside FROM deals JOIN o USING (variant_id) WHERE {OCCURRED} AND first_seen <= {NOW}),
g AS (SELECT *, CASE WHEN inside THEN datesub('day', lag(first_seen) OVER (PARTITION BY variant_id, inside ORDER BY first_seen), first_seen) END AS gap FROM s)
SELECT variant_id, count(*) FILTER (inside) AS event_count, count(*) FILTER (inside) >= 5 AS guard_met, CASE WHEN count(*) FILTER (inside) >= 5 THEN CAST(round(quantile_cont(gap, 0.5)) AS BIGINT) END AS interval_median_days,
  datesub('day', max(first_seen), {NOW}) AS elapsed_days, datesub('month', greatest(any_value(since), {NOW} - INTERVAL 6 MONTH), {NOW}) AS observed_months FROM g GROUP BY 1""")
def cadence_view(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark.cadence(deals(spark, sf), now())


@registered(f"""{WITH}, q AS (SELECT variant_id, count(*) AS n, quantile_cont(price_first, 0.25) AS q1, quantile_cont(price_first, 0.75) AS q3 FROM deals GROUP BY 1)
SELECT deal_event_id, CASE WHEN n >= 5 THEN CASE WHEN price_first < q1 - 1.5 * (q3 - q1) THEN 'LOWER' WHEN price_first > q3 + 1.5 * (q3 - q1) THEN 'UPPER' ELSE 'NONE' END
  WHEN price_first < current_price * 0.5 THEN 'LOWER' WHEN price_first > current_price * 1.5 THEN 'UPPER' ELSE 'NONE' END AS flag
FROM deals JOIN q USING (variant_id) LEFT JOIN params USING (variant_id)""")
def outlier_flags(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.outliers(deals(spark, sf), params(spark, sf).select("variant_id", "current_price"))


#: What alerts, with purchases of all four states: those of urgent orders are archived.
BOUGHT = PURCHASES.replace("ELSE 'CLOSED' END AS state", "ELSE CASE WHEN o_orderpriority LIKE '5%' THEN 'ARCHIVED' ELSE 'CLOSED' END END AS state").replace("o_orderkey % (SELECT count(*) FROM part) AS variant_id", "o_orderkey % (SELECT count(*) FROM part) AS variant_id, o_orderdate AS bought_at")
DECIDED = VIEW + f""", u AS (SELECT variant_id, max(paid_price) FILTER (state = 'OBSERVING') AS paid, bool_and(state = 'ARCHIVED') AS archived FROM ({BOUGHT}) GROUP BY 1),
k AS (SELECT deal_event_id, deals.variant_id, outlier_flag, quiet_start AS a, quiet_end AS z, demand_axis_value,
  CASE WHEN n_sites >= 2 THEN n_sites || '개 사이트 검증' ELSE '미검증(단독)' END || CASE tier WHEN 'SPARSE' THEN ' · 표본 ' || n || '건 · 참고용' WHEN 'NONE' THEN ' · 기준 미확립 · 참고용' ELSE '' END AS labels,
  list_filter([CASE WHEN archived IS NOT true AND outlier_flag = 'LOWER' THEN 'JACKPOT' END, CASE WHEN price_first <= good_deal_line THEN 'SPECIAL' END, CASE WHEN archived IS NOT true AND price_first <= target_price THEN 'TARGET' END,
    CASE WHEN price_first <= benchmark_price OR (tier = 'SPARSE' AND price_first <= lowest_case) OR (tier = 'NONE' AND price_first <= view.current_price * 0.7) THEN 'GOOD' END, CASE WHEN price_first < paid THEN 'PAID_PRICE' END], lambda x: x IS NOT NULL) AS kinds
  FROM deals JOIN view USING (variant_id) JOIN params USING (variant_id) LEFT JOIN u USING (variant_id) WHERE status <> 'ENDED'),
decided AS (SELECT deal_event_id, variant_id, demand_axis_value, kinds[1] AS kind, array_to_string(kinds[2:], ',') AS also, labels,
  CASE WHEN kinds[1] <> 'JACKPOT' AND coalesce(a <> z AND CASE WHEN a < z THEN 8 >= a AND 8 < z ELSE 8 >= a OR 8 < z END, false) THEN 'HELD' ELSE 'SENT' END AS outcome
FROM k WHERE len(kinds) > 0)"""


@registered(DECIDED + "SELECT * EXCLUDE (demand_axis_value) FROM decided")
def alert_decisions(spark: SparkSession, sf: str) -> DataFrame:
    d, p = deals(spark, sf), params(spark, sf)
    return alerts.alert_decisions(d, benchmark.benchmark(d, p, now()), p.select("variant_id", "target_price", "quiet_start", "quiet_end"), F.lit(8), relation(spark, sf, BOUGHT))


@registered(f"""{WITH}, o AS (SELECT variant_id, min(first_seen) AS since FROM deals GROUP BY 1),
g AS (SELECT purchase_id, count(*) AS n, count(*) FILTER (price_first < paid_price) AS c, min(price_min) AS low FROM purchases p JOIN deals d
  ON p.variant_id = d.variant_id AND {PRICING} AND first_seen BETWEEN purchased_at AND purchased_at + to_days(CAST(observation_days AS INTEGER)) GROUP BY 1),
r AS (SELECT p.*, coalesce(purchased_at < since, false) AS un, g.n, g.c, g.low FROM purchases p LEFT JOIN o USING (variant_id) LEFT JOIN g USING (purchase_id))
SELECT purchase_id, un AS unobserved, CASE WHEN un THEN 0 ELSE coalesce(n, 0) END AS n, CASE WHEN un THEN 0 ELSE coalesce(c, 0) END AS cheaper_count,
  CAST(CASE WHEN NOT un AND n > 0 THEN floor(c * 1000 / n + 0.5) / 1000 END AS DECIMAL(4, 3)) AS percentile, CASE WHEN NOT un THEN low END AS lowest_opportunity,
  CASE WHEN purchase_id % 3 = 0 THEN paid_price - 20000 END AS paid_gap FROM r""")
def report_cards(spark: SparkSession, sf: str) -> DataFrame:
    frozen = F.when(F.col("purchase_id") % 3 == 0, 20_000).cast("long")
    return purchases.report_cards(relation(spark, sf, PURCHASES).withColumn("snap_benchmark_price", frozen), deals(spark, sf))


@registered(f"""{WITH} SELECT purchase_id, CASE WHEN state = 'OBSERVING' AND {NOW} >= purchased_at + to_days(CAST(observation_days AS INTEGER)) THEN 'REPORT_PENDING' ELSE state END AS state FROM purchases""")
def expired_observations(spark: SparkSession, sf: str) -> DataFrame:
    return purchases.expired(relation(spark, sf, PURCHASES), now())


@registered(f"""{WITH}, a AS (SELECT variant_id, min(price_last) AS low FROM deals WHERE {ON} GROUP BY 1),
c AS (SELECT purchase_id, count(*) AS n FROM purchases p JOIN deals d ON p.variant_id = d.variant_id AND {PRICING} AND price_min < paid_price GROUP BY 1),
k AS (SELECT p.*, low, n, CASE WHEN state = 'REPORT_PENDING' THEN 'REPORT_PENDING' WHEN low IS NOT NULL THEN 'ACTIVE_DEAL' ELSE 'NO_ACTIVE_DEAL' END AS kind FROM purchases p LEFT JOIN a USING (variant_id) LEFT JOIN c USING (purchase_id) WHERE state <> 'CLOSED')
SELECT purchase_id, kind, CASE WHEN kind = 'ACTIVE_DEAL' THEN low END AS active_lowest, CASE WHEN kind = 'ACTIVE_DEAL' THEN paid_price - low END AS overpaid_won,
  CAST(CASE WHEN kind = 'ACTIVE_DEAL' THEN round(CAST(paid_price - low AS DECIMAL(18, 0)) / paid_price, 3) END AS DECIMAL(12, 3)) AS overpaid_ratio,
  CASE WHEN kind = 'NO_ACTIVE_DEAL' THEN datesub('day', purchased_at, {NOW}) + 1 END AS day, CASE WHEN kind = 'NO_ACTIVE_DEAL' THEN coalesce(n, 0) END AS cheaper_chances FROM k""")
def observation_context(spark: SparkSession, sf: str) -> DataFrame:
    return purchases.observation_context(relation(spark, sf, PURCHASES), deals(spark, sf), now())


def members(f, where: str):
    """How many deals of each variant a named set holds, and their prices' sum."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return f(deals(spark, sf)).groupBy("variant_id").agg(F.count("*").alias("n"), F.sum("price_first").alias("total"))

    QUERIES[f.__name__] = run
    SQL[f.__name__] = f"{WITH} SELECT variant_id, count(*) AS n, CAST(sum(price_first) AS BIGINT) AS total FROM deals WHERE {where} GROUP BY 1"


members(dealsets.pricing_set, PRICING)
members(dealsets.occurrence_set, OCCURRED)
members(dealsets.signal_set, ON)

SNAPS = f"WITH o AS ({OBSERVATIONS}), s AS (SELECT used_search_id, batch, listing_id, arg_max(price, event_id) AS price FROM o GROUP BY 1, 2, 3)"


@registered(SNAPS + """, c AS (SELECT used_search_id, batch, lead(batch) OVER (PARTITION BY used_search_id ORDER BY batch) AS nb FROM (SELECT DISTINCT used_search_id, batch FROM s)),
a AS (SELECT s.*, nb FROM s JOIN c USING (used_search_id, batch) WHERE nb IS NOT NULL), b AS (SELECT * FROM s WHERE (used_search_id, batch) IN (SELECT used_search_id, nb FROM c))
SELECT used_search_id, coalesce(b.batch, a.nb) AS batch, listing_id, CASE WHEN a.batch IS NULL THEN 'APPEARED' WHEN b.batch IS NULL THEN 'DISAPPEARED' ELSE 'PRICE_CHANGED' END AS kind, a.price AS prev_price, b.price AS price
FROM a FULL JOIN b ON a.used_search_id = b.used_search_id AND a.listing_id = b.listing_id AND a.nb = b.batch WHERE a.batch IS NULL OR b.batch IS NULL OR a.price IS DISTINCT FROM b.price""".replace("SELECT used_search_id, coalesce", "SELECT coalesce(b.used_search_id, a.used_search_id) AS used_search_id, coalesce").replace("AS batch, listing_id,", "AS batch, coalesce(a.listing_id, b.listing_id) AS listing_id,"))
def listing_diff(spark: SparkSession, sf: str) -> DataFrame:
    return used.batch_diffs(relation(spark, sf, OBSERVATIONS))


@registered(SNAPS + """, c AS (SELECT used_search_id, batch, row_number() OVER w AS i, lead(batch) OVER w AS nb FROM (SELECT DISTINCT used_search_id, batch FROM s) WINDOW w AS (PARTITION BY used_search_id ORDER BY batch)),
x AS (SELECT s.*, c.i, c.nb, lag(i) OVER o AS b, lag(price) OVER o AS was, lead(i) OVER o AS a FROM s JOIN c USING (used_search_id, batch) WINDOW o AS (PARTITION BY used_search_id, listing_id ORDER BY i))
SELECT used_search_id, listing_id, batch, CASE WHEN b IS NULL THEN 'NEW' WHEN b <> i - 1 THEN 'REVIVED' ELSE 'PRICE' END AS event, price FROM x WHERE b IS NULL OR b <> i - 1 OR was <> price
UNION ALL SELECT used_search_id, listing_id, nb, 'SOLD', price FROM x WHERE nb IS NOT NULL AND coalesce(a, 0) <> i + 1""")
def listing_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    return used.lifecycle(relation(spark, sf, OBSERVATIONS))


@registered(f"""WITH p AS ({POLLS}), l AS (SELECT *, coalesce(max(outcome = 'BLOCKED') OVER (PARTITION BY site ORDER BY seen_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM p),
r AS (SELECT site, outcome, seen_at, count(*) FILTER (outcome = 'OK') OVER (PARTITION BY site ORDER BY seen_at DESC, event_id DESC) AS later FROM l WHERE NOT over),
c AS (SELECT site, max(seen_at) FILTER (outcome = 'OK') AS last_ok, count(*) FILTER (outcome = 'TRANSIENT' AND later = 0) AS failures, bool_or(outcome = 'BLOCKED') AS stopped FROM r GROUP BY 1)
SELECT *, CASE WHEN stopped THEN NULL WHEN failures = 0 THEN 60 ELSE CAST(least(1800, 60 * 2 ** (failures - 1)) AS BIGINT) END AS next_s FROM c""")
def poll_cursors(spark: SparkSession, sf: str) -> DataFrame:
    return polls.cursors(relation(spark, sf, POLLS))


#: Streaks by runs: the rows since the last row that broke one.
@registered(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seen_at, event_id) AS n FROM ({POLLS}) WHERE outcome <> 'BLOCKED'),
q AS (SELECT *, n - coalesce(max(CASE WHEN NOT (outcome = 'OK' AND deal_count = 0) THEN n END) OVER o, 0) AS e, n - coalesce(max(CASE WHEN NOT (outcome = 'OK' AND deal_count > 0 AND priced_count = 0) THEN n END) OVER o, 0) AS l,
  count(*) FILTER (outcome = 'OK') OVER (PARTITION BY site ORDER BY seen_at, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS g, count(*) FILTER (outcome = 'OK' AND deal_count > 0 AND priced_count > 0) OVER o AS term
  FROM p WINDOW o AS (PARTITION BY site ORDER BY seen_at, event_id)),
d AS (SELECT *, CASE WHEN e >= 3 THEN 'EMPTY' WHEN l >= 3 THEN 'PRICELESS' WHEN n >= 10 AND g < 6 THEN 'UNSTABLE' END AS reason FROM q)
SELECT site, event_id, reason FROM (SELECT *, row_number() OVER (PARTITION BY site, term ORDER BY seen_at, event_id) AS k FROM d WHERE reason IS NOT NULL) WHERE k = 1""")
def drift_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return polls.drift(relation(spark, sf, POLLS))


@registered(f"""WITH p AS ({POLLS}) SELECT site, count(*) AS polls, CAST(sum(deal_count) AS BIGINT) AS deals, count(*) FILTER (outcome = 'TRANSIENT') AS failures,
  count(*) FILTER (outcome = 'BLOCKED') AS blocked, CAST(sum(deal_count - priced_count) AS BIGINT) AS priceless FROM p GROUP BY 1""")
def cycle_counters(spark: SparkSession, sf: str) -> DataFrame:
    return polls.cycle_counters(relation(spark, sf, POLLS))


@registered(f"{SNAPS} SELECT listing_id, used_search_id, arg_max(price, batch) AS price FROM s GROUP BY 1, 2")
def latest_price(spark: SparkSession, sf: str) -> DataFrame:
    s = used.snapshots(relation(spark, sf, OBSERVATIONS))
    return s.groupBy("listing_id", "used_search_id").agg(F.max_by("price", "batch").alias("price"))


@registered(f"{SNAPS}, m AS (SELECT used_search_id, CAST(round(quantile_cont(price, 0.5)) AS BIGINT) AS bench FROM s GROUP BY 1) SELECT used_search_id, batch, listing_id, CASE WHEN bench > 0 THEN CAST(floor((bench - price) * 100.0 / bench + 0.5) AS BIGINT) END AS pct FROM s JOIN m USING (used_search_id)")
def used_price_context(spark: SparkSession, sf: str) -> DataFrame:
    from pricelens.functions.numbers import percentile_won

    s = used.snapshots(relation(spark, sf, OBSERVATIONS))
    bench = s.groupBy("used_search_id").agg(percentile_won(F.col("price"), 0.5).alias("bench"))
    return s.join(bench, "used_search_id").select("used_search_id", "batch", "listing_id", used_percent(F.col("bench"), F.col("price")).alias("pct"))
