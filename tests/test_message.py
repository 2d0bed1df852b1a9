"""The digest's lines, and its parts against packing the joined text at once."""

import random

import pytest
from pyspark.sql import functions as F

from pricelens.operators import message, titles


@pytest.mark.parametrize("most,n,longest,partitions", [(60, 400, 30, 7), (60, 300, 80, 5), (400, 30, 60, 3), (40, 1, 5, 4), (4000, 50, 20, 4), (30, 200, 3, 11)])
def test_parts_are_those_of_the_joined_text(spark, most, n, longest, partitions):
    rng = random.Random(n)
    lines = ["가b😀 "[rng.randrange(4)] * rng.randint(1, longest) for _ in range(n)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "place int, line string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = [r.text for r in message.message_parts(df, most).orderBy("i").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    (want,) = spark.createDataFrame([("\n".join(lines),)], "t string").select(titles.split_digest(F.col("t"), most).alias("ps")).collect()
    assert got == want.ps


def test_a_digest_of_the_models_shape(spark):
    row = "variant_id long, product string, variant string, best long, active boolean, basis string, was string, now string, reportable boolean, in_window long, ever long, pins array<string>"
    rows = spark.createDataFrame([
        (2, "폰", "256GB", 1234567, True, None, "RED", "GREEN", True, 2, 9, ["BOUGHT", "REVIVED"]), (1, None, "흑", 5, False, "흑", None, "RED", False, 0, 3, []),
        (3, None, None, None, None, None, None, None, False, 1, 1, None), (4, "x", "y", None, None, None, "RED", "RED", False, 0, 7, []),
    ], row)
    line = message.variant_line(*(F.col(c) for c in ("product", "variant", "best", "active", "basis", "was", "now", "reportable", "in_window", "ever", "pins")))
    waiting = spark.createDataFrame([("a", 0), (None, 3)], "subject string, digest_appearances int")
    text = lambda rows, waiting: [r.line for r in message.assembled(rows, message.queue_line(waiting)).orderBy("place").collect()]
    told = rows.select("variant_id", line.alias("line"), ((F.col("in_window") > 0) | F.col("reportable")).alias("moved"))
    assert text(told, waiting) == [
        message.HEAD, "흑 · ⛔ 최고 기회 5원(basis=흑) · 관찰 이번 창 +0 / 누적 3", "폰 256GB · 🟢 최고 기회 1,234,567원(basis=전체) · 🔁 🔴RED → 🟢GREEN · 관찰 이번 창 +2 / 누적 9 · 📌 샀어요 · 📌 ↩️ 다시 살아남",
        "대상 미상 · 관찰 이번 창 +1 / 누적 1", "· 나머지 1개 항목은 변동 없음", "⑤ 검토 대기 2건(대상 미상 1건 포함) · 최다 4회째 미확인",
    ]
    assert text(told.filter("variant_id = 4"), waiting.limit(0)) == [message.HEAD, message.QUIET, "⑤ 검토 대기: 없음"]
    pinned = rows.filter("variant_id = 4").withColumn("pins", F.array(F.lit("MISSED"))).select("variant_id", line.alias("line"), F.lit(False).alias("moved"))
    assert text(pinned, waiting.limit(0)) == [message.HEAD, message.QUIET, "⑤ 검토 대기: 없음"]  # a pin's end alone makes no news
    assert text(told.limit(0), waiting.filter("subject = 'a'")) == [message.HEAD, message.QUIET, "⑤ 검토 대기 1건"]
