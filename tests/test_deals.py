"""The deal operators on hand-checked vectors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricelens.functions.price_text import normalize_price
from pricelens.operators import benchmark, outliers, polls, used

NOW = dt.datetime(2026, 7, 15)

#: Titles and what they state.
PRICES = [
    ("아이폰 3만원 + 배송비 3,000원", 33000, []), ("아이폰 3.3만원 무료배송", 33000, []), ("아이폰 N카드 할인 시 890,000", 890000, ["N카드"]), ("아이폰 팝니다 문의 주세요", None, None),
    ("갤럭시 89만", 890000, []), ("갤럭시 33000", 33000, []), ("갤럭시 890,000원", 890000, []), ("[알리] OLOyDDR5 32GB(16x2)5600MHz 513,000", 513000, []), ("x(13,490원/3,000원)", 16490, []),
    ("x(1,200원~/3,000원)", 4200, []), ("x (16,450원/유배)", 16450, ["유료배송(금액미상)", "배송비미상"]), ("[롯데온]폴햄 (11,800원/착불)", 11800, ["배송비:착불", "배송비미상"]),
    ("[G마켓]TV (11,800원/3,000원~)", 14800, ["배송비:3,000원~", "배송비미상"]), ("x (8800원 /픽업)", 8800, ["수령:픽업"]), ("[플레이스토어]구글플레이패스 신규 1달 (무료/무료)", 0, ["무료가"]), ("(무료/2,500원)", 2500, ["무료가"]),
    ("[GOG] Nexus: The Jupiter Incident 무료", 0, ["무료가"]), ("[쿠팡]갤럭시 S24 5000만화소 카메라 899,000원", 899000, []), ("[다나와]모니터 2만2천원", 22000, []), ("RTX 5070 특가", None, None), ("5600X 정품", None, None), ("i5-14600K", None, None),
    ("20000mAh", None, None), ("[G마켓]라면 13490", 13490, []), ("긴 제목 (13,800원...", 13800, ["배송비미상"]), (None, None, None), ("", None, None),
    # Expected results of the model's own examples.
    ("[롯데온]경남제약 파워 블랙마카 1,000mg*60정 (9,600원/무료)", 9600, []), ("[네이버]안국약품 콘드로이친 1200 60정,3개+밀크씨슬1개(34,710원/무료)", 34710, []), ("[옥션]레노마 남성 반소매 셔츠 모음전 (26,980원/무배)", 26980, []),
    ("[던킨] 네이버페이 결제시 아메리카노 900원 (7/4~7)", 900, []), ("[플레이스토어] 스폰지밥: 비키니시 전쟁 150원", 150, []), ("완전 무료배송 이벤트 참여", None, None), ("[무료나눔 이벤트 당첨자 발표] 실제 판매가 13,000원", 13000, []),
    ("[한길담]100매 한정 코엑스 아쿠아리움 1인 입장권 (7/31까지) (18,300원/무료)", 18300, []), ("[지마켓]삼성 로봇청소기 (카할180만원대/무배)", 1800000, ["카할"]), ("[다나와]MSI RTX 5070 그래픽카드 (899,000원/무료)", 899000, []),
    ("[SSG]스타벅스 기프트카드 5만원권 (45,000원/무료)", 45000, []), ("[다나와]그래픽카드가 899,000원", 899000, []), ("[11번가]LG TV (1,290,000원/무료) 신한카드 할인", 1290000, ["신한카드"]), ("[SSG]다이슨 (599,000원/무료) 현대카드 청구할인", 599000, ["현대카드"]),
    ("[옥션]에어팟 (199,000원/무료) 카드할인 적용", 199000, ["카드할인"]), ("[11번가]TV (1,000,000원/무료) 카드 결제 시", 1000000, ["카드결제"]), ("[G마켓]에어컨 3만시간 보증 599,000원", 599000, []), ("[11번가]보조배터리 2만mAh 19,900원", 19900, []),
    ("3.3만원 특가", 33000, []), ("[옥션]키보드 8만원대 특가", 80000, []), ("[11번가]선풍기 (11,800원/조건부무료)", 11800, ["조건부무료배송:조건부무료", "배송비미상"]), ("[쿠팡]키보드 (11,800원/2500)", 14300, []),
    ("[컴퓨존]RTX 4090 재입고", None, None), ("[퀘이사존]라이젠 7 5600X 정품", None, None), ("키보드 12,000원 배송비 2,500원 신한카드 KB국민카드 카할", 14500, ["신한카드", "KB국민카드", "카할"]), ("마우스 유배 9,900원", 9900, ["유료배송(금액미상)", "배송비미상"]), ("긴 제목 12000...", 12000, ["배송비미상"]), ("긴 제목 배송비 500원 12000...", 12500, []),
]


def test_price_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(PRICES)], "i int, t string")
    for r in df.select("i", normalize_price(F.col("t")).alias("p")).collect():
        text, won, tags = PRICES[r.i]
        assert (r.p and r.p.won, r.p and r.p.tags) == (won, tags), text


def deal(i, price, seen, sites=1, flag="NONE", last=None):
    return (str(i), 1, price, last or price, sites, flag, False, False, False, False, "ACTIVE", seen, seen)


DEAL = "deal_event_id string, variant_id int, price_first long, price_last long, n_sites int, outlier_flag string, permanently_excluded boolean, unclassified boolean, shipping_unknown boolean, free_price boolean, status string, first_seen timestamp_ntz, last_seen timestamp_ntz"
PARAM = "variant_id int, period_months int, k_display int, current_price long"


def view(spark, deals, k=5, period=6):
    df = spark.createDataFrame(deals, DEAL)
    return benchmark.benchmark(df, spark.createDataFrame([(1, period, k, None)], PARAM), F.lit(NOW).cast("timestamp_ntz")).first()


def day(month, d):
    return dt.datetime(2026, month, d)


def test_benchmark_of_five_deals(spark):
    deals = [deal(1, 800_000, day(7, 1)), deal(2, 820_000, day(6, 20), 2), deal(3, 850_000, day(6, 10)), deal(4, 900_000, day(7, 12), 2), deal(5, 950_000, day(5, 15))]
    r = view(spark, deals + [deal(6, 5_000_000, day(7, 2), flag="UPPER"), deal(7, 10_000, day(7, 2), flag="LOWER")])
    assert (r.tier, r.n, r.m, r.benchmark_price, r.latest_price, r.expanded_to_months) == ("SUFFICIENT", 5, 2, 850_000, 900_000, None)


def test_benchmark_lines_come_from_cross_verified_deals(spark):
    r = view(spark, [deal(i, p * 1000, day(7, 1 + i), 2 if i < 2 else 1) for i, p in enumerate((820, 880, 800, 850, 900, 950))])
    assert (r.benchmark_price, r.good_deal_line, r.period_lowest, r.n, r.m) == (865_000, 835_000, 820_000, 6, 2)


@pytest.mark.parametrize("n,k,tier", [(0, 3, "NONE"), (1, 3, "SPARSE"), (4, 3, "SUFFICIENT"), (4, 5, "SPARSE"), (5, 5, "SUFFICIENT"), (5, 10, "SPARSE"), (7, 10, "SPARSE"), (7, 3, "SUFFICIENT")])
def test_tiers(spark, n, k, tier):
    r = view(spark, [deal(i, 100_000, day(7, 1)) for i in range(n)], k)
    assert (r.tier, r.n) == (tier, n) and (r.benchmark_price is None) == (tier != "SUFFICIENT")


def test_window_grows_only_where_that_adds_deals(spark):
    old = [deal(i, 100_000, day(1, 10)) for i in range(3)]  # in the seventh month back
    assert view(spark, old, 3, period=3).expanded_to_months == 7
    assert view(spark, [deal(1, 1, day(7, 1))], 3, period=3).expanded_to_months is None


@pytest.mark.parametrize("price,flag", [(5_000_000, "UPPER"), (890_001, "UPPER"), (890_000, "NONE"), (830_000, "NONE"), (770_000, "NONE"), (769_999, "LOWER")])
def test_tukey_fences(spark, price, flag):
    q1, q3 = 815_000, 845_000
    assert spark.range(1).select(outliers.band(F.lit(price), F.lit(q1 - 1.5 * (q3 - q1)), F.lit(q3 + 1.5 * (q3 - q1)))).first()[0] == flag


def test_listing_diff(spark):
    snap = lambda *rows: spark.createDataFrame(list(rows), "listing_id string, price long")
    got = {tuple(r) for r in used.listing_diff(snap(("A", 900), ("B", 1), ("C", 5)), snap(("A", 850), ("C", 5), ("D", 7))).collect()}
    assert got == {("A", "PRICE_CHANGED", 900, 850), ("B", "DISAPPEARED", 1, None), ("D", "APPEARED", None, 7)}


def test_drift_alerts_once_until_healthy(spark):
    rows = [("s", i, NOW + dt.timedelta(minutes=i), o, d, p) for i, (o, d, p) in enumerate([("OK", 0, 0)] * 5 + [("BLOCKED", 0, 0)] + [("OK", 3, 2)] + [("OK", 3, 0)] * 4)]
    got = [tuple(r) for r in polls.drift(spark.createDataFrame(rows, "site string, event_id int, seen_at timestamp_ntz, outcome string, deal_count long, priced_count long")).orderBy("event_id").collect()]
    assert got == [("s", 2, "EMPTY"), ("s", 9, "PRICELESS")]
