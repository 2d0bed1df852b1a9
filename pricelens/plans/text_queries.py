"""What a person reads of benchmarks, cadence, signals, purchases and pins, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions import texts

from .queries import QUERIES, SQL, VIEW, registered
from .review_queries import PINS
from .views import relation

SAMPLE = "n || '건(교차 ' || m || '건)'"
WIDER = "coalesce(' · ' || expanded_to_months || '개월로 확장', '')"


@registered(VIEW + f""", g AS (SELECT *, current_price - benchmark_price AS gap_won, CAST(round(CAST((current_price - benchmark_price) * 100 AS DECIMAL(20, 0)) / benchmark_price, 1) AS DECIMAL(12, 1)) AS gap_pct FROM view)
SELECT variant_id, CASE tier WHEN 'NONE' THEN '수집된 딜이 없습니다 — ' || {SAMPLE} WHEN 'SPARSE' THEN '표본이 적어 기준가를 산출하지 않습니다 — ' || {SAMPLE} || ', 사례만 나열' || {WIDER}
  ELSE '핫딜 기준가 ' || format('{{:,}}', benchmark_price) || '원' || coalesce(' · 굿딜라인 ' || format('{{:,}}', good_deal_line) || '원', '') || ' · ' || {SAMPLE} || {WIDER} END AS benchmark,
  '현재가 ' || format('{{:,}}', current_price) || '원' || CASE WHEN gap_won IS NULL THEN ' — 비교할 기준가가 없습니다' WHEN gap_won = 0 THEN ' — 기준가와 같습니다'
  ELSE ' — 기준가보다 ' || format('{{:,}}', abs(gap_won)) || '원 ' || CASE WHEN gap_won > 0 THEN '비쌈' ELSE '쌈' END || ' (' || CASE WHEN gap_pct > 0 THEN '+' ELSE '' END || gap_pct || '%)' END AS gap FROM g""".replace("g AS (SELECT *, current_price", "gp AS (SELECT *, current_price").replace("AS gap FROM g", "AS gap FROM gp"))
def decision_lines(spark: SparkSession, sf: str) -> DataFrame:
    v = QUERIES["benchmark_view"](spark, sf)
    c = F.col
    return v.select("variant_id", texts.benchmark_line(c("tier"), c("n"), c("m"), c("benchmark_price"), c("good_deal_line"), c("expanded_to_months")).alias("benchmark"), texts.gap_line(c("current_price"), c("gap_won"), c("gap_pct")).alias("gap"))


@registered(f"""WITH c AS ({SQL['cadence_view']}) SELECT variant_id, CASE WHEN event_count = 0 THEN '최근 ' || observed_months || '개월 발생 없음' WHEN NOT guard_met OR interval_median_days IS NULL THEN observed_months || '개월 ' || event_count || '회 — 주기 판단 불가(표본 부족)' || coalesce(' · 마지막 딜 ' || elapsed_days || '일 전', '')
  ELSE observed_months || '개월 ' || event_count || '회 · 간격 median ' || interval_median_days || '일' || coalesce(' · 마지막 딜 ' || elapsed_days || '일 전', '') END AS line FROM c""")
def cadence_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return QUERIES["cadence_view"](spark, sf).select("variant_id", texts.cadence_line(c("observed_months"), c("event_count"), c("guard_met"), c("interval_median_days"), c("elapsed_days")).alias("line"))


@registered(f"""WITH s AS ({SQL['signal_view']}) SELECT variant_id, CASE color WHEN 'GREEN' THEN '지금 잡을 딜 있음' WHEN 'YELLOW' THEN '기준가 아래 딜 있음' WHEN 'RED' THEN '지금은 잡을 딜 없음' ELSE '표본 부족 — 판단 보류' END AS badge FROM s""")
def signal_badges(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["signal_view"](spark, sf).select("variant_id", texts.named(texts.BADGES, F.col("color")).alias("badge"))


#: The purchases of a list, each with its report card or, while it is observed, how it stands.
@registered(f"""WITH r AS ({SQL['report_cards']}), o AS ({SQL['observation_context']})
SELECT purchase_id, CASE WHEN unobserved THEN '관측 시작 이전 구매라 성적을 낼 수 없습니다' WHEN n = 0 THEN '관찰 기간에 비교할 딜이 없었습니다' ELSE concat_ws(' · ', n || '건 중 ' || cheaper_count || '건이 내 구매가보다 쌌습니다',
    CASE WHEN paid_gap = 0 THEN '기준가와 같음' ELSE '기준가보다 ' || format('{{:,}}', abs(paid_gap)) || '원 ' || CASE WHEN paid_gap > 0 THEN '비쌈' ELSE '쌈' END END, '기간 내 최저 ' || format('{{:,}}', lowest_opportunity) || '원') END AS card,
  CASE kind WHEN 'REPORT_PENDING' THEN '관찰 종료 · 성적표는 아직 발급되지 않습니다' WHEN 'ACTIVE_DEAL' THEN '활성 딜 최저 ' || format('{{:,}}', active_lowest) || '원 — ' || CASE WHEN overpaid_won = 0 THEN '구매가와 같음' ELSE format('{{:,}}', abs(overpaid_won)) || '원 ' || CASE WHEN overpaid_won > 0 THEN '더 주고 샀음' ELSE '싸게 샀음' END || ' (' || CASE WHEN round(overpaid_ratio, 1) > 0 THEN '+' ELSE '' END || CAST(round(overpaid_ratio, 1) AS DECIMAL(12, 1)) || '%)' END
    WHEN 'NO_ACTIVE_DEAL' THEN '활성 딜 없음 · 관찰 ' || day || '일차 · 더 싼 기회 ' || cheaper_chances || '건' END AS standing
FROM r LEFT JOIN o USING (purchase_id)""")
def purchase_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    df = QUERIES["report_cards"](spark, sf).join(QUERIES["observation_context"](spark, sf), "purchase_id", "left")
    standing = texts.observation_line(c("kind"), c("active_lowest"), c("overpaid_won"), c("overpaid_ratio"), c("day"), c("cheaper_chances"))
    return df.select("purchase_id", texts.report_card_line(c("unobserved"), c("n"), c("cheaper_count"), c("paid_gap"), c("lowest_opportunity")).alias("card"), F.when(c("kind").isNotNull(), standing).alias("standing"))


@registered(f"SELECT pin_id, CASE state WHEN 'ACTIVE' THEN '관찰 중' WHEN 'BOUGHT' THEN '샀어요' WHEN 'MISSED' THEN '놓쳤어요(종료됨)' ELSE '기각·해제' END AS label, CASE WHEN pin_id % 3 = 0 THEN '순번 미지정' ELSE pin_id % 9 || '순위' END AS rank FROM ({PINS})")
def pin_labels(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("pin_id") % 3 != 0, F.col("pin_id") % 9)
    return relation(spark, sf, PINS).select("pin_id", texts.named(texts.PIN_LABELS, F.col("state")).alias("label"), texts.rank_label(rank).alias("rank"))
