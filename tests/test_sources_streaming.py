import datetime as dt
import random

from pyspark.sql import functions as F

from pricelens.functions import rules
from pricelens.operators import fold, polls, titles
from pricelens.sources import html, listings
from pricelens.sources.html import rows_of, scan_boards
from pricelens.streaming.polls import cursor_stream

NOW = dt.datetime(2026, 7, 15)


def test_cursors_as_a_stream_are_those_in_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"s{i % 4}", i, NOW + dt.timedelta(minutes=i), rng.choices(["OK", "TRANSIENT", "BLOCKED"], [4, 6, 0.3])[0]) for i in range(120)]
    schema = "site string, event_id long, seen_at timestamp, outcome string"
    for k in range(4):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    last: dict = {}
    q = cursor_stream(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: last.update({r.site: tuple(r) for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = polls.cursors(spark.createDataFrame(rows, schema)).select("site", "last_ok", "failures", "stopped", "next_s").collect()
    assert last == {r.site: tuple(r) for r in want}


# Pages of the boards' shape.
PAGES = [
    (1, "ppomppu", '<table><tr class="baseList bbs_new1"><td class="baseList-numb">123</td><td><a class="baseList-title" href="view.php?id=ppomppu&page=1&no=123">[11번가] <b>라면</b> (13,490원/3,000원)</a></td><td class="baseList-rec">5 - 0</td><td><time class="baseList-time">21:10:11</time></td></tr>'
     '<tr class="baseList bbs_new1"><td class="baseList-numb">124</td><td class="end2"><a class="baseList-title" href="view.php?id=ppomppu&no=124">끝난 딜 카할 9,900원</a><td class="baseList-time">26/07/03</td></tr><tr class="baseList bbs_new1"><td class="baseList-numb">9</td><td><a class="baseList-title" href="view.php?id=other&no=9">다른 게시판</a></td></tr>'
     '<tr class="baseList notice"><td class="baseList-numb">1</td><td><a class="baseList-title" href="view.php?id=ppomppu&no=1">공지</a></td></tr></table>'),
    (2, "ruliweb", '<table class="board_list_table"><tr class="table_body normal"><td><input class="info_article_id" value="55"></td><td><a><div class="title_wrapper">[품절]<a class="subject_link" href="https://b/read/55">딜 [종료] 아님 8만원</a></div></a></td><td class="recomd"><strong>1,204</strong></td><td class="time">날짜 2026.07.03</td></tr>'
     '<tr class="table_body normal"><td><input class="info_article_id" value="56"></td><td><div class="title_wrapper"><a href="/read/56">특가 [마감] 임박</a></div></td></tr><tr class="table_body normal best"><td><input class="info_article_id" value="1"></td></tr></table><tr class="table_body normal"><td><input class="info_article_id" value="2"></td></tr>'),
    (3, "fmkorea", '<div id="content"><div class="fm_best_widget"><ul><li class="li"><h3 class="title"><a href="/777/">키보드</a></h3><div class="hotdeal_info"><a>쇼핑몰</a><a>11,800원</a><a>2,500원</a></div><span class="regdate">09:30</span><span class="pc_voted_count"><b class="count">12</b></span></li>'
     '<li class="li hotdeal_var8Y"><h3 class="title"><span class="hotdeal_var8Y"></span><a href="/778">마우스</a></h3><div class="hotdeal_info"><a>쇼핑몰</a><a>9,900원</a></div></li><li><h3 class="title"><a href="/779">값없음</a></h3></li></ul></div></div><ul><li><h3 class="title"><a href="/1">x</a></h3></li></ul>'),
    (4, "fmkorea", None), (5, None, "<tr>"), (6, "ruliweb", "<table class='board_list_table'><tr class='table_body normal'><td><a href="),
]


def test_boards(spark):
    now = F.lit(dt.datetime(2026, 7, 15, 3, 0)).cast("timestamp_ntz")
    rows = scan_boards(spark.createDataFrame(PAGES, "page_id long, site string, html string"), now).orderBy("page_id", "post_id").collect()
    assert [(r.post_id, r.title, r.status, r.reaction, r.headline_price, r.applied_conditions, r.posted_at) for r in rows] == [
        ("123", "[11번가]라면(13,490원/3,000원)", "ACTIVE", 5, 16490, [], dt.datetime(2026, 7, 15, 12, 10, 11)), ("124", "끝난 딜 카할 9,900원", "SOLD_OUT", 0, 9900, ["카할"], dt.datetime(2026, 7, 3, 14, 59)),
        ("55", "딜 [종료] 아님 8만원", "SOLD_OUT", 1204, 80000, [], dt.datetime(2026, 7, 3, 14, 59)), ("56", "특가 [마감] 임박", "ACTIVE", 0, None, [], None),
        ("777", "키보드", "ACTIVE", 12, 14300, [], dt.datetime(2026, 7, 15, 0, 30)), ("778", "마우스", "SOLD_OUT", 0, 9900, ["배송비미상"], None), ("779", "값없음", "ACTIVE", 0, None, [], None),
    ]
    assert [r.url for r in rows][:3] == ["https://www.ppomppu.co.kr/zboard/view.php?id=ppomppu&no=123", "https://www.ppomppu.co.kr/zboard/view.php?id=ppomppu&no=124", "https://b/read/55"]


def test_no_page_breaks_a_scan():
    """Deep, unclosed, huge and cut pages, and marks without an end or a beginning."""
    row = '<tr class="baseList bbs_new1"><td class="baseList-numb">7</td><td><a class="baseList-title" href="?id=ppomppu&no=7">산딜 5,000원</a></td><td class="baseList-rec">²</td></tr>'
    want = [("7", "산딜 5,000원", "https://www.ppomppu.co.kr/zboard/view.php?id=ppomppu&no=7", "ACTIVE", 0, None, "산딜 5,000원", None)]
    for page in ("<div>" * 100_000 + row, row + "<b>" * 100_000 + "</i>" * 100_000, "</td>" * 100_000 + row, "<table>" + "<p>x" * 50_000 + row + "</p>" * 60_000, row + "<a href='", row + "<!-- no end", row + "<![CDATA[ x", "<![x[<!<?>" + row, "<![ ]if>" + row, "<script>if (a < b) '<tr>'</script>" + row):
        assert rows_of(page, "ppomppu") == want
    assert rows_of("<tr class='baseList bbs_new1'>" * 20_000, "ppomppu") == [] and rows_of("<ul><li>" * 50_000, "fmkorea") == [] and rows_of("<table class=board_list_table>" + "<tr class='table_body normal'>" * 50_000, "ruliweb") == []
    many = rows_of("<table>" + row * 20_000, "ppomppu")
    assert len(many) == 20_000 and set(many) == set(want)


def test_elements_that_never_end_hold_what_follows():
    page = '<tr class="baseList bbs_new1"><td class="baseList-numb">7<td><a class="baseList-title" href="?id=ppomppu">a <script>b</script><b>c<td class="baseList-rec">3 - 1<span class="end2">'
    assert rows_of(page, "ppomppu") == []  # the number's text goes on to the end
    (row,) = rows_of(page.replace("7<td>", "7</td><td>"), "ppomppu")
    assert row[:5] == ("7", "ac3 - 1", "https://www.ppomppu.co.kr/zboard/view.php?id=ppomppu&no=7", "SOLD_OUT", 3)
    (row,) = rows_of('<table class="board_list_table"><tr class="table_body normal"><td class="info_article_id" value="9"><div class="title_wrapper">x</div><div class="title_wrapper"><a href="/r">t<![CDATA[u]]></a>[종료]', "ruliweb")
    assert row[:4] == ("9", "tu", "/r", "ACTIVE")  # marks count in the first wrapper only


def test_board_times(spark):
    now = F.lit(dt.datetime(2026, 7, 14, 15, 30)).cast("timestamp_ntz")  # half past midnight in Korea
    want = {"21:10": dt.datetime(2026, 7, 14, 12, 10), " 날짜 00:29:59 ": dt.datetime(2026, 7, 14, 15, 29, 59), "26/07/03": dt.datetime(2026, 7, 3, 14, 59), "2026.7.3": dt.datetime(2026, 7, 3, 14, 59), "25:99": None, "12:30:60": None, "13/45/99": None, "2026-07-03": None, "": None, "어제": None}
    df = spark.createDataFrame([(t,) for t in [*want, None]], "t string").select("t", rules.board_time(F.col("t"), now).alias("at"))
    assert {r.t: r["at"] for r in df.collect()} == {**want, None: None}


def test_small_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    arr = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    assert [one(rules.allowed_site(F.lit(s).cast("string"))) for s in (" Ppomppu ", "bunjang", None)] == [True, False, False]
    assert [one(rules.keyword_verdict(F.lit("중고 폰"), arr("중고"), F.lit(x))) for x in (True, False)] == ["LABELED", "EXCLUDED"]
    assert one(rules.keyword_verdict(F.lit("폰"), arr("중고"), F.lit(True))) == "CLEAN"
    assert one(rules.normalized_keywords(arr(" b ", "a", "", "b", None))) == ["b", "a"] and one(rules.normalized_keywords(F.lit(None).cast("array<string>"))) == []
    assert [one(rules.keyword_setting(F.lit(j).cast("string"))) for j in ('["a", " b"]', "{}", "[1", None, '"x"')] == [["a", "b"], [], [], [], []]
    assert [one(rules.needs_detail(F.lit(p).cast("long"), F.lit(t), arr("아이폰 17"))) for p, t in ((None, "아이폰 1 7 특..."), (5, "아이폰 17..."), (None, "아이폰 17"), (None, "갤럭시..."))] == [True, False, False, False]
    policy = lambda *xs: one(rules.policy_errors(*(F.lit(x).cast("int") for x in xs)))
    assert policy(6, 5, None, 22, 7) == [] and policy(0, 2, 0, 22, None) == ["period", "k_display", "target", "quiet_hours"] and policy(6, 10, 1, 24, 0) == ["hour"]
    assert one(rules.registration_errors(F.lit(" "), F.lit("X"), arr())) == ["name", "mode", "variants"] and one(rules.registration_errors(F.lit("a"), F.lit("SPLIT"), arr("v"))) == []
    assert one(rules.variant_labels([arr("256GB", "512GB"), arr("흑", "백")])) == ["256GB / 흑", "256GB / 백", "512GB / 흑", "512GB / 백"]
    assert one(rules.split_list(F.lit(" a, b\n\na ,c"))) == ["a", "b", "c"]
    assert one(rules.korean_date(F.lit(dt.datetime(2026, 7, 14, 15, 0)).cast("timestamp_ntz"))) == dt.date(2026, 7, 15)
    assert [round(one(rules.gauge(F.lit(v), [F.lit(100), F.lit(None).cast("int"), F.lit(200)])), 6) for v in (100, 150, 200)] == [round(100 * 8 / 116, 6), 50.0, round(100 * 108 / 116, 6)]
    assert one(rules.gauge(F.lit(5), [F.lit(5)])) == 50.0 and one(rules.gauge(F.lit(0), [F.lit(0)])) is None
    assert [one(rules.backoff(F.lit(n))) for n in (0, 1, 3, 20)] == [0, 60, 240, 1800] and [one(rules.poll_interval(F.lit(30), F.lit(m))) for m in (False, True)] == [60, 600]
    assert [one(rules.http_outcome(F.lit(s).cast("int"))) for s in (200, 204, 301, 403, 429, 500, None)] == ["OK", "OK", "TRANSIENT", "BLOCKED", "BLOCKED", "TRANSIENT", "TRANSIENT"]
    assert one(rules.market_url(F.lit("BUNJANG"), arr("아이폰", "17 pro"))).endswith("q=%EC%95%84%EC%9D%B4%ED%8F%B0%2017%20pro&n=100")
    assert [one(rules.post_status(F.lit(s).cast("string"))) for s in ("SOLD_OUT", "DELETED", "ACTIVE", None)] == ["ENDED", "ENDED", "ACTIVE", "ACTIVE"]
    deal = F.struct(F.lit(5).cast("long").alias("price_min"), F.lit(9).cast("long").alias("price_max"), F.lit(7).cast("long").alias("price_last"), F.lit("ACTIVE").alias("status"))
    assert tuple(one(rules.repriced(deal, F.lit(12).cast("long")))) == (5, 12, 12, "ACTIVE")


def test_listings_of_a_market(spark):
    json = '{"list": [{"pid": 7, "name": "폰", "price": "900", "status": "0", "update_time": 1752537600, "free_shipping": true, "num_faved": 3, "uid": 5}, {"pid": "8", "price": "문의", "status": "1", "update_time": 1}, {"name": "x"}]}'
    df = listings.scan_listings(spark.createDataFrame([(1, json), (2, None), (3, "no json"), (4, "{}")], "page_id long, json string"))
    assert [(r.post_id, r.title, r.headline_price, r.status, r.reaction, r.applied_conditions, r.posted_at) for r in df.orderBy("post_id").collect()] == [
        ("7", "폰", 900, "ACTIVE", 3, [], dt.datetime(2025, 7, 15)), ("8", "", None, "SOLD_OUT", 0, ["유료배송(금액미상)", "배송비미상"], dt.datetime(1970, 1, 1, 0, 0, 1)),
    ]
    kept, dropped = listings.priced(df)
    assert (kept.count(), dropped.first().dropped) == (1, 1)


def test_merge_bounds(spark):
    hour = 3600

    def deals(*posts):
        rows = [(1, f"p{i}", price, at, site, status) for i, (price, at, site, status) in enumerate(posts)]
        return sorted(tuple(r) for r in fold.fold_deals(spark.createDataFrame(rows, "variant_id int, post_id string, price long, seen long, site int, status string")).select("price_first", "price_last", "sites", "status", "posts").collect())

    live = "ACTIVE"
    for price, at, n in ((1_020_000, 0, 1), (1_020_001, 0, 2), (980_000, 0, 1), (979_999, 0, 2), (1_000_000, 48 * hour, 1), (1_000_000, 48 * hour + 1, 2)):
        assert len(deals((1_000_000, 0, 1, live), (price, at, 1, live))) == n
    assert deals((100_000, 0, 1, "ENDED"), (105_000, hour, 2, live)) == [(100_000, 105_000, 3, "VERIFIED", 2)]
    # five boards' posts, two of which are one deal
    assert sorted(d[4] for d in deals(*((p * 1000, 0, 1, live) for p in (830, 860, 890, 920, 950)), (892_000, 0, 2, live))) == [1, 1, 1, 1, 2]


def test_titles(spark):
    df = spark.createDataFrame([("아이폰 17 256기가 자급제", "아이폰17256GB자급제"), ("SSD 2테라 4T 8G한글 9Gx", "SSD2TB4TB8GB한글9Gx")], "t string, j string")
    assert df.filter(titles.joined(F.col("t")) != F.col("j")).count() == 0
    (parts,) = spark.range(1).select(titles.split_digest(F.lit("a" * 10 + "\n" + "b" * 10 + "\n" + "c" * 10), 32)).first()
    assert parts == ["(1/2) " + "a" * 10 + "\n" + "b" * 10, "(2/2) " + "c" * 10]


def test_plain_pages_need_no_general_parser(spark, monkeypatch):
    """Tags that are written plainly are told once each; times and prices are taken in the same pass. What isn't plain gives what the parser gives."""
    fed = []
    feed = html.HTMLParser.feed
    monkeypatch.setattr(html.HTMLParser, "feed", lambda self, data: (fed.append(data), feed(self, data))[1])
    row = '<tr class="baseList bbs_new1"><td class="baseList-numb">{0}</td><td><a class="baseList-title" href="view.php?id=ppomppu&no={0}">a {0}</a></td></tr>'
    head = '<!DOCTYPE html><title>x</title><script src="x">if (a<b) "<td>";</script><!-- a --><table>'
    assert [r[0] for r in rows_of(head + "".join(row.format(n) for n in range(50)), "ppomppu")] == [str(n) for n in range(50)] and not fed
    for odd in ("<a title='<b>'>", "<br/ x>", "<script><!-- </script>", "a < b", "<p =x>", "<title>&amp;<b></title>", "</ x>"):
        pages = [html.Page(odd + row.format(1)), html.Page.__new__(html.Page)]
        monkeypatch.setattr(html.Page, "plain", lambda self, page: 0)
        pages[1].__init__(odd + row.format(1))
        monkeypatch.undo()
        assert all([getattr(p, k) for k in ("kinds", "parent", "end", "texts")] == [getattr(pages[0], k) for k in ("kinds", "parent", "end", "texts")] for p in pages)
    plan = scan_boards(spark.createDataFrame(PAGES, "page_id long, site string, html string"), F.current_timestamp().cast("timestamp_ntz"))._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "ArrowEvalPython" not in plan
