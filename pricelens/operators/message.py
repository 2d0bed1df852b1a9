"""A digest as one message in parts: lines of all variants in order, packed into parts without one task holding the text.

Parts are packed greedily, so where one begins hangs on all lines before it.
But within a range of lines the first part that begins there begins among its
first lines, those that fit into a part at most; for each of these it is known
how long the range's last part is then. One pass over these, a few a range,
tells how full the part is that each range goes on with.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.lineage import cut

# The message's words, icons and the room that numbering takes.
HEAD, QUIET = "📋 주간 다이제스트 (발송 시점 현재 지식 기준)", "이번 주는 조용했습니다 — 가격 변동·신호 전환 없음."
COLORS = {"GREEN": "🟢GREEN", "YELLOW": "🟡YELLOW", "RED": "🔴RED", "GRAY": "⚪GRAY"}
PINS = {"BOUGHT": "📌 샀어요", "MISSED": "📌 놓쳤어요", "REVIVED": "📌 ↩️ 다시 살아남"}
NOBODY, EVERYONE, RESERVED = "대상 미상", "전체", 10


def one_of(c: Column, names: dict[str, str]) -> Column:
    out = F.lit("-")
    for key, name in names.items():
        out = F.when(c == key, name).otherwise(out)
    return out


def subject(product: Column, variant: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(" ", product, variant), F.lit("")), F.lit(NOBODY))


def variant_line(product: Column, variant: Column, best: Column, active: Column, basis: Column, was: Column, now: Column, reportable: Column, in_window: Column, ever: Column, pins: Column) -> Column:
    """What a digest says of a variant; null where there is nothing to say: no chance (best), none in the window, no change of colour, no pin's end."""
    chance = F.when(best.isNotNull(), F.concat(F.when(active, "🟢").otherwise("⛔"), F.lit(" 최고 기회 "), F.format_number(best, 0), F.lit("원(basis="), F.coalesce(basis, F.lit(EVERYONE)), F.lit(")")))
    turn = F.when(reportable, F.concat(F.lit("🔁 "), one_of(was, COLORS), F.lit(" → "), one_of(now, COLORS)))
    watched = F.concat(F.lit("관찰 이번 창 +"), in_window.cast("string"), F.lit(" / 누적 "), ever.cast("string"))
    ends = F.array_join(F.transform(pins, lambda p: one_of(p, PINS)), " · ")
    said = best.isNotNull() | (in_window > 0) | F.coalesce(reportable, F.lit(False)) | (F.coalesce(F.size(pins), F.lit(0)) > 0)
    return F.when(said, F.concat_ws(" · ", subject(product, variant), chance, turn, watched, F.nullif(ends, F.lit(""))))


def queue_line(waiting: DataFrame) -> DataFrame:
    """line: how many items wait (subject, digest_appearances), how many of nobody's, and how often the longest has been shown, this time included."""
    n, none, most = F.count("*"), F.count_if(F.col("subject").isNull()), F.max(F.col("digest_appearances") + 1)
    some = F.concat(
        F.lit("⑤ 검토 대기 "), n.cast("string"), F.lit("건"), F.when(none > 0, F.concat(F.lit("("), F.lit(NOBODY), F.lit(" "), none.cast("string"), F.lit("건 포함)"))).otherwise(""),
        F.when(most > 1, F.concat(F.lit(" · 최다 "), most.cast("string"), F.lit("회째 미확인"))).otherwise(""),
    )
    return waiting.agg(F.when(n == 0, "⑤ 검토 대기: 없음").otherwise(some).alias("line"))


def assembled(rows: DataFrame, waiting: DataFrame) -> DataFrame:
    """place (a pair of numbers to order by), line: the whole digest of rows (variant_id, line or null, moved: whether it had a chance or a change of colour).

    Its head; each line by variant, then how many variants have none - or, if
    nothing moved, that the week was quiet, and no variant's line; what waits.
    """
    line = lambda at, text: F.struct(F.struct(F.lit(at).alias("step"), F.lit(0).cast("long").alias("n")).alias("place"), text.alias("line"))
    quiet = ~F.coalesce(F.bool_or("moved"), F.lit(False))
    none = F.count_if(F.col("line").isNull())
    rest = F.when(quiet, QUIET).when(none > 0, F.concat(F.lit("· 나머지 "), none.cast("string"), F.lit("개 항목은 변동 없음")))
    frame = rows.agg(F.array(line(0, F.lit(HEAD)), line(2, rest)).alias("xs")).select(F.inline("xs"))
    own = rows.filter(F.col("line").isNotNull() & ~rows.agg(quiet.alias("quiet")).scalar()).select(F.struct(F.lit(1).alias("step"), F.col("variant_id").cast("long").alias("n")).alias("place"), "line")
    end = waiting.select(F.struct(F.lit(3).alias("step"), F.lit(0).cast("long").alias("n")).alias("place"), "line")
    return frame.unionByName(own).unionByName(end).filter("line IS NOT NULL AND line <> ''")


def openings(room: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each line of a range that can be the first to begin a part: the lengths of what stands before it there, and of the range's last part then. Lines come sorted by range, then place."""
        held = None
        for f in frames:
            for part, own in f.groupby("part", sort=False):
                if held is not None and held[0] != part:
                    yield told(*held)
                    held = None
                held = (part, own["n"].tolist()) if held is None else (part, held[1] + own["n"].tolist())
        if held is not None:
            yield told(*held)

    def told(part: int, n: list[int]) -> pd.DataFrame:
        total = [0]
        for x in n:
            total.append(total[-1] + x + 1)
        # the line that begins the part after one that begins at i, then the length of the last part of that chain
        last, after = [0] * (len(n) + 1), len(n)
        for i in range(len(n) - 1, -1, -1):
            while after > i + 1 and total[after] - total[i] - 1 > room:
                after -= 1
            last[i] = total[len(n)] - total[i] - 1 if after == len(n) else last[after]
        first = [i for i in range(len(n)) if i == 0 or total[i] <= room + 1]
        return pd.DataFrame({"part": part, "at": first, "before": [total[i] for i in first], "n": [n[i] for i in first], "last": [last[i] for i in first], "whole": total[-1]})

    return run


def carried(room: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """With what length of an open part each range goes on (null for the first)."""
        part, whole, open_, was, done = None, 0, None, None, False
        for f in frames:
            out = []
            for p, before, n, last, whole_ in zip(f["part"], f["before"], f["n"], f["last"], f["whole"]):
                if p != part:
                    if part is not None:
                        open_ = open_ if done else was + whole
                        out.append((part, was))
                    part, whole, was, done = p, whole_, open_, False
                # the open part takes the lines before this one, but not this one
                if not done and (was is None or was + before + n + 1 > room):
                    open_, done = last, True
            yield pd.DataFrame(out, columns=["part", "open"]).astype({"open": "Int64"})
        if part is not None:
            yield pd.DataFrame([(part, was)], columns=["part", "open"]).astype({"open": "Int64"})

    return run


def begins(room: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each line, and whether it begins a part."""
        part, open_ = None, None
        for f in frames:
            out = []
            for p, n, given in zip(f["part"], f["n"], f["open"]):
                if p != part:
                    part, open_ = p, None if pd.isna(given) else int(given)
                fresh = open_ is None or open_ + n + 1 > room
                open_ = n if fresh else open_ + n + 1
                out.append(fresh)
            yield f.assign(fresh=out)[["part", "k", "line", "fresh"]]

    return run


def message_parts(lines: DataFrame, most: int) -> DataFrame:
    """i, n, text: the parts of lines (place, line) in the order of place: whole lines under most characters less what numbering takes, a longer line a part by itself; parts are numbered where there are several. As split_digest has them of the joined text."""
    room = most - RESERVED
    df = lines.repartitionByRange("place").sortWithinPartitions("place").select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("k"), "line", F.length("line").alias("n"))
    df = cut(df)
    sorted_ = lambda d: d.repartition("part").sortWithinPartitions("part", "k")
    first = sorted_(df).select("part", "n").mapInPandas(openings(room), "part int, at int, before long, n long, last long, whole long")
    # a few rows a range, whatever the text; broadcast from the start, as a shuffled join by part would stand for the repartition, and need not keep a part whole
    open_ = first.coalesce(1).sortWithinPartitions("part", "at").mapInPandas(carried(room), "part int, open long")
    told = sorted_(df.join(F.broadcast(open_), "part", "left")).select("part", "k", "n", "line", "open").mapInPandas(begins(room), "part int, k long, line string, fresh boolean")
    told = cut(told)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = told.groupBy("part").agg(F.count_if("fresh").alias("c")).withColumn("offset", F.coalesce(F.sum("c").over(before), F.lit(0))).select("part", "offset")
    inside = Window.partitionBy("part").orderBy("k")
    numbered = told.join(offsets, "part").withColumn("i", F.col("offset") + F.count_if("fresh").over(inside))
    parts = numbered.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("part", "k", "line"))).alias("xs"))
    n = offsets.join(told.groupBy("part").agg(F.count_if("fresh").alias("c")), "part").agg(F.max(F.col("offset") + F.col("c")).alias("n"))
    text = F.array_join(F.transform("xs", lambda x: x["line"]), "\n")
    df = parts.withColumn("n", n.scalar())
    return df.select("i", "n", F.when(F.col("n") > 1, F.concat(F.lit("("), F.col("i").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(") "), text)).otherwise(text).alias("text"))
