"""Messages and labels, as column expressions. Lines that are null or empty are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headlines of alerts, follow-ups and second-hand listings.
HEADLINES = {"JACKPOT": "🔥 역대급 특가", "SPECIAL": "🟢 특가", "TARGET": "🎯 목표가 이하", "GOOD": "🟢 괜찮은 딜", "PAID_PRICE": "🛒 내 구매가보다 쌈"}
FOLLOW_UPS = {"VERIFIED": "✅ 교차검증됨", "PRICE_CHANGED": "🔁 가격 변동", "ENDED": "⛔ 종료됨", "REOPENED": "↩️ 다시 살아남", "PINNED_PRICE_INCREASED": "📈 지켜보던 딜 가격 인상"}
USED = {"NEW": "🆕 중고 신규 매물", "PRICE_DROP": "📉 중고 가격 하락", "SOLD_OUT": "⛔ 중고 매물 소실 (판매완료 추정 — 원문 확인 필요)"}
UNNAMED, CONDITIONS, MAY_COST_MORE, UNKNOWN_SHIPPING = "대상 미상", "⚠️ 조건: ", " (실 결제가는 표시가보다 높을 수 있음)", "배송비미상"


def named(names: dict[str, str], key: Column) -> Column:
    return F.coalesce(*(F.when(key == k, v) for k, v in names.items()))


def won(price: Column) -> Column:
    """13,490원; null for null."""
    return F.concat(F.format_number(price, 0), F.lit("원"))


def lines(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (F.trim(x) != "")), "\n")


def subject(product: Column, variant: Column) -> Column:
    """Product and variant, or what there is of them."""
    both = F.concat_ws(" ", product, variant)
    return F.when(product.isNull() & variant.isNull(), UNNAMED).otherwise(both)


def percent(part: Column, whole: Column) -> Column:
    """With one decimal, halves away from zero."""
    return F.round(part.cast("decimal(20,0)") * 100 / whole.cast("decimal(20,0)"), 1).cast("decimal(12,1)").cast("string")


def comparison(price: Column, tier: Column, n: Column, benchmark: Column, lowest: Column) -> Column:
    """How a price stands against the benchmark; without one, what there is to go by."""
    less = benchmark - price
    line = F.concat(
        F.lit("기준가 "), won(benchmark), F.when(less > 0, F.concat(F.lit("보다 "), won(less), F.lit("("), percent(less, benchmark), F.lit("%) 쌈"))).otherwise(""),
        F.coalesce(F.concat(F.lit(" · 역대최저 "), won(lowest)), F.lit("")),
    )
    return F.when((tier == "SUFFICIENT") & benchmark.isNotNull(), line).when(tier == "SPARSE", F.concat(F.lit("표본 "), n.cast("string"), F.lit("건뿐이라 기준가 대신 참고"))).otherwise("기준 미확립(참고용)")


def conditions(tags: Column) -> Column:
    """A line of sorted tags; null for none."""
    line = F.concat(F.lit(CONDITIONS), F.array_join(F.array_sort(tags), " · "))
    return F.when(F.size(tags) > 0, F.concat(line, F.when(F.array_contains(tags, UNKNOWN_SHIPPING), MAY_COST_MORE).otherwise("")))


def alert_message(kind: Column, also: Column, labels: Column, named_: Column, price: Column, compared: Column, verified: Column, tags: Column, url: Column) -> Column:
    """A first alert's text; also is an array of kinds, labels one of texts, verified the number of sites that a benchmark rests on."""
    plain = {k: v.split(" ", 1)[1] for k, v in HEADLINES.items()}
    more = F.concat(F.transform(also, lambda k: named(plain, k)), labels)
    more = F.when(F.size(more) > 0, F.concat(F.lit("· "), F.array_join(more, " · ")))
    check = F.when(verified > 0, F.concat(F.lit("✅ "), verified.cast("string"), F.lit("개 사이트 교차검증")))
    return lines(named(HEADLINES, kind), named_, won(price), compared, check, more, conditions(tags), url)


def follow_up_message(kind: Column, named_: Column, price: Column, tags: Column, url: Column) -> Column:
    latest = F.when(kind.isin("PRICE_CHANGED", "PINNED_PRICE_INCREASED"), "최신가 ").otherwise("")
    return lines(named(FOLLOW_UPS, kind), named_, F.concat(latest, won(price)), conditions(tags), url)


def used_message(kind: Column, product: Column, title: Column, was: Column, price: Column, url: Column) -> Column:
    change = F.when((kind == "PRICE_DROP") & was.isNotNull(), F.concat(won(was), F.lit(" → "), won(price))).otherwise(won(price))
    return lines(named(USED, kind), F.when(F.trim(product) != "", product).otherwise(UNNAMED), title, change, url)


# Badges and labels of signals, pins, ranks and purchases.
BADGES = {"GREEN": "지금 잡을 딜 있음", "YELLOW": "기준가 아래 딜 있음", "RED": "지금은 잡을 딜 없음", "GRAY": "표본 부족 — 판단 보류"}
PIN_LABELS = {"ACTIVE": "관찰 중", "BOUGHT": "샀어요", "MISSED": "놓쳤어요(종료됨)", "DROPPED": "기각·해제"}


def signed(percent_: Column) -> Column:
    """A percentage with one decimal, with its sign where it is above 0."""
    return F.concat(F.when(percent_ > 0, "+").otherwise(""), percent_.cast("decimal(12,1)").cast("string"), F.lit("%"))


def dearer(amount: Column) -> Column:
    return F.when(amount > 0, "비쌈").otherwise("쌈")


def benchmark_line(tier: Column, n: Column, m: Column, benchmark: Column, good: Column, months: Column) -> Column:
    sample = F.concat(n.cast("string"), F.lit("건(교차 "), m.cast("string"), F.lit("건)"))
    wider = F.coalesce(F.concat(F.lit(" · "), months.cast("string"), F.lit("개월로 확장")), F.lit(""))
    full = F.concat(F.lit("핫딜 기준가 "), won(benchmark), F.coalesce(F.concat(F.lit(" · 굿딜라인 "), won(good)), F.lit("")), F.lit(" · "), sample, wider)
    few = F.concat(F.lit("표본이 적어 기준가를 산출하지 않습니다 — "), sample, F.lit(", 사례만 나열"), wider)
    return F.when(tier == "NONE", F.concat(F.lit("수집된 딜이 없습니다 — "), sample)).when(tier == "SPARSE", few).when(benchmark.isNull(), F.concat(F.lit("기준가를 받지 못했습니다 — "), sample)).otherwise(full)


def gap_line(current: Column, gap_won: Column, gap_pct: Column) -> Column:
    """How the current price stands against the benchmark; null without a current price."""
    now = F.concat(F.lit("현재가 "), won(current))
    apart = F.concat(now, F.lit(" — 기준가보다 "), won(F.abs(gap_won)), F.lit(" "), dearer(gap_won), F.lit(" ("), signed(gap_pct), F.lit(")"))
    return F.when(gap_won.isNull(), F.concat(now, F.lit(" — 비교할 기준가가 없습니다"))).when(gap_won == 0, F.concat(now, F.lit(" — 기준가와 같습니다"))).otherwise(apart)


def cadence_line(months: Column, count: Column, guard: Column, median: Column, elapsed: Column) -> Column:
    window, n = F.concat(months.cast("string"), F.lit("개월")), F.concat(F.lit(" "), count.cast("string"), F.lit("회"))
    last = F.coalesce(F.concat(F.lit(" · 마지막 딜 "), elapsed.cast("string"), F.lit("일 전")), F.lit(""))
    told = F.when(~guard | median.isNull(), F.concat(window, n, F.lit(" — 주기 판단 불가(표본 부족)"), last)).otherwise(F.concat(window, n, F.lit(" · 간격 median "), median.cast("string"), F.lit("일"), last))
    return F.when(count == 0, F.concat(F.lit("최근 "), window, F.lit(" 발생 없음"))).otherwise(told)


def report_card_line(unobserved: Column, n: Column, cheaper: Column, gap_won: Column, lowest: Column) -> Column:
    gap_ = F.when(gap_won == 0, "기준가와 같음").otherwise(F.concat(F.lit("기준가보다 "), won(F.abs(gap_won)), F.lit(" "), dearer(gap_won)))
    parts = F.concat_ws(" · ", F.concat(n.cast("string"), F.lit("건 중 "), cheaper.cast("string"), F.lit("건이 내 구매가보다 쌌습니다")), gap_, F.concat(F.lit("기간 내 최저 "), won(lowest)))
    return F.when(unobserved, "관측 시작 이전 구매라 성적을 낼 수 없습니다").when(n == 0, "관찰 기간에 비교할 딜이 없었습니다").otherwise(parts)


def observation_line(kind: Column, lowest: Column, overpaid: Column, ratio: Column, day: Column, chances: Column) -> Column:
    """The ratio is printed as it is, as a share with one decimal."""
    on = F.concat(F.lit("활성 딜 최저 "), won(lowest))
    verdict = F.when(overpaid > 0, "더 주고 샀음").otherwise("싸게 샀음")
    apart = F.when(overpaid == 0, F.concat(on, F.lit(" — 구매가와 같음"))).otherwise(F.concat(on, F.lit(" — "), won(F.abs(overpaid)), F.lit(" "), verdict, F.lit(" ("), signed(F.round(ratio, 1)), F.lit(")")))
    off = F.concat(F.lit("활성 딜 없음 · 관찰 "), day.cast("string"), F.lit("일차 · 더 싼 기회 "), chances.cast("string"), F.lit("건"))
    return F.when(kind == "REPORT_PENDING", "관찰 종료 · 성적표는 아직 발급되지 않습니다").when(kind == "ACTIVE_DEAL", F.coalesce(apart, on)).otherwise(off)


def prefill_notice(tags: Column) -> Column:
    """What to heed when a deal's price fills a purchase form."""
    card = F.exists(tags, lambda t: (t == "카할") | t.contains("카드"))
    return F.when(F.array_contains(tags, UNKNOWN_SHIPPING), "⚠ 배송비를 못 읽어 하한입니다 — 실제 낸 금액으로 고치세요").when(card, "⚠ '카드할인' 조건이 붙은 가격입니다 — 그 카드로 안 샀다면 고치세요").otherwise("이 딜의 관측가(배송비 포함)입니다. 쿠폰·적립을 따로 썼다면 고치세요")


def rank_label(rank: Column) -> Column:
    return F.coalesce(F.concat(rank.cast("string"), F.lit("순위")), F.lit("순번 미지정"))
