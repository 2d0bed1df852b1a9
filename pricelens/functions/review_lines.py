"""What the review queue shows of an item: why it waits, what it is about, since when."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import korean_date

# The words of the queue.
REASONS = {
    "UNCLASSIFIED": "미상 — 어느 제품인지 확정하지 못했습니다. 사람이 원문을 보고 정합니다.",
    "OUTLIER_LOWER": "분포 하단 이상치 — 기준가 표본에서 제외됐습니다. 원문을 보고 판단하세요.",
    "DEMAND_UNKNOWN": "수요축 값 미상 — 제목에서 값을 판별하지 못해 기준가에서 빠졌습니다. 원문을 보고 분류하세요.",
    "KEYWORD_SUGGEST": "🔕 사후학습 — 무시한 딜에 자주 나온 키워드입니다. 정책 패널의 제외 키워드에 추가하면 이 노이즈가 줄어듭니다.",
}
NO_TITLE, NO_SUBJECT, NO_CANDIDATES, SHIPPING_UNKNOWN = "제목 없음", "대상 미상", "후보 없음", "배송비미상"


def reason(kind: Column) -> Column:
    out = F.concat(F.lit("알 수 없는 유형("), kind, F.lit(") — 근거를 그대로 표시합니다."))
    for name, said in REASONS.items():
        out = F.when(kind == name, said).otherwise(out)
    return out


def seen_line(occurrences: Column, first: Column, last: Column) -> Column:
    """Since when an item waits, by Korean dates, and how often it came again."""
    a, b = korean_date(first).cast("string"), korean_date(last).cast("string")
    span = F.when(a == b, a).otherwise(F.concat(a, F.lit(" ~ "), b))
    return F.when(occurrences == 1, F.concat(a, F.lit(" 접수"))).otherwise(F.concat(span, F.lit(" · 같은 항목이 "), occurrences.cast("string"), F.lit("번 다시 쌓였습니다 (수집 파이프라인이 매 주기 재처리합니다)")))


def condition_line(conditions: Column) -> Column:
    """A deal's conditions, with a warning where shipping is unknown; null for none."""
    tags = F.concat(F.lit("조건부: "), F.array_join(conditions, " · "))
    return F.when(F.size(conditions) > 0, F.when(F.array_contains(conditions, SHIPPING_UNKNOWN), F.concat(tags, F.lit(" (배송비 미상이라 실제 결제가는 더 높습니다)"))).otherwise(tags))


def detail(kind: Column, title: Column, candidates: Column, subject: Column, price: Column, conditions: Column, suggested: Column, payload: Column) -> Column:
    """What an item is about; an unknown kind shows its payload."""
    title = F.coalesce(F.nullif(title, F.lit("")), F.lit(NO_TITLE))
    subject = F.coalesce(subject, F.lit(NO_SUBJECT))
    listed = lambda c, what: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit(what), F.array_join(c, ", "))).otherwise(NO_CANDIDATES)
    won = F.coalesce(F.concat(F.format_number(price, 0), F.lit("원")), F.lit("null"))
    return (
        F.when(kind == "UNCLASSIFIED", F.concat(title, F.lit(" · "), listed(candidates, "후보: ")))
        .when(kind == "OUTLIER_LOWER", F.concat_ws(" · ", subject, won, condition_line(conditions)))
        .when(kind == "DEMAND_UNKNOWN", F.concat(subject, F.lit(" · "), title))
        .when(kind == "KEYWORD_SUGGEST", listed(suggested, "제외 키워드 후보: "))
        .otherwise(payload)
    )
