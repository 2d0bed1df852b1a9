import hashlib
import re
import zlib
from itertools import product

import numpy as np
import pytest

from pricelens.llm import conversation_repair as C

GOOD = re.compile(r"(s?(ua)+)?")


def brute(rows, inserts=4):
    """The cheapest of all edits with at most so many insertions: rows of (role, text, must go, truncated)."""
    best = None

    def go(at, left, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        if at == len(rows) and GOOD.fullmatch("".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        if left:
            for role in ("user", "assistant"):
                go(at, left - 1, cost + 2, audit + "I", [*out, (role, "")])
        if at < len(rows):
            role, text, gone, cut = rows[at]
            go(at + 1, left, cost + 3, audit + "D", out)
            if not gone:
                go(at + 1, left, cost + cut, audit + "K", [*out, (role, text)])
                for other in ("user", "assistant"):
                    go(at + 1, left, cost + 2 + cut, audit + "R", [*out, (other, text)])

    go(0, inserts, 0, "", [])
    return best


def faults(rows):
    """rows of (turn, role, text) in order: blank, duplicate, truncated, illegal, and the rows as brute() takes them."""
    seen, n, out = set(), [0, 0, 0], []
    for _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 0 if not marks else 1 if (role, text) in seen else 2 if marks[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            n[fault] += 1
        out.append((role, text, fault in (0, 1), int(fault == 2)))
    return *n, sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), out


def expected(conv, turns):
    """The whole result of one conversation from its undamaged (turn, role, text)."""
    rows = []
    for turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    blank, duplicate, truncated, illegal, plain = faults(rows)
    known = [t for t, _, _ in rows if t is not None]
    cost, audit, out = brute(plain)
    return conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def test_every_short_run_of_turns_as_by_brute_force():
    kinds = [("user", "u.", False, 0), ("assistant", "a.", False, 0), ("system", "s", False, 1), ("tool", "t.", False, 0), ("user", " ", True, 0), ("", "x", False, 1)]
    for n in range(4):
        for rows in product(kinds, repeat=n):
            repair = C.Repair()
            for role, text, gone, cut in rows:
                repair.step(role[:1] if role[:1] in ("s", "u", "a") else "", gone, cut, role, text)
            cost, audit, out = brute(rows)
            assert repair.row()[5:] == (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()), rows


def test_a_cut_turn_whose_deletion_costs_as_much_as_an_insertion_before_it():
    """Two users, the second cut: to insert an assistant and keep it costs 3, as deleting does, and D reads less; all short runs with cut turns of each role as by brute force."""
    repair = C.Repair()
    for role, text in (("user", "u."), ("user", "cut"), ("assistant", "a.")):
        repair.add(len(text), role, text, False)
    assert repair.row()[5:7] == (3, "KDK")
    kinds = [("user", "u.", False, 0), ("assistant", "a.", False, 0), ("user", "cut", False, 1), ("assistant", "off", False, 1), ("system", "s", False, 1), ("system", "s.", False, 0)]
    for rows in product(kinds, repeat=3):
        repair = C.Repair()
        for role, text, gone, cut in rows:
            repair.step(role[:1], gone, cut, role, text)
        cost, audit, out = brute(rows)
        assert repair.row()[5:] == (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()), rows


ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
TEXTS = ["Hello there.", "Fine!", "Why?", "cut off", "", None, " \t\n", "x. ", "énd.  ", "\U0001f600"]


@pytest.fixture(scope="module")
def conversations():
    odds = np.random.default_rng(5)
    return {conv: [(None if odds.random() < 0.1 else int(odds.integers(-2, 5)), ROLES[odds.integers(len(ROLES))], TEXTS[odds.integers(len(TEXTS))]) for _ in range(odds.integers(1, 6))] for conv in [None, *range(60)]}


def test_as_by_brute_force(spark, conversations):
    rows = [(c, *t, "clash", True) for c, turns in conversations.items() for t in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, seen boolean").repartition(3)
    got = {r.conv_id: tuple(r) for r in C.repair_conversations(df).collect()}
    assert got == {c: expected(c, t) for c, t in conversations.items()}
    assert C.repair_conversations(df.limit(0)).collect() == []


def test_names_as_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 1, "user", "Hi."), ("a", 2, "assistant", "Yes.")], "id string, n int, who string, said string")
    (r,) = C.repair_conversations(df, "id", "n", "who", "said").collect()
    assert tuple(r) == expected("a", [(1, "user", "Hi."), (1, "user", "Hi."), (2, "assistant", "Yes.")])


def test_a_giant_conversation_is_carried_over_batches_and_spilled(spark, monkeypatch):
    """20,000 turns in batches of 1,000, the way back in a file, against the same turns repaired in memory."""
    from pyspark.sql import functions as F

    turns = spark.range(20_000).select(
        F.lit("c").alias("conv"), F.lit(True).alias("numbered"), F.col("id").alias("turn"), F.element_at(F.array(*map(F.lit, ("user", "assistant", "assistant", "tool", "user"))), (F.col("id") % 5 + 1).cast("int")).alias("role"),
        F.concat(F.lit("text "), (F.col("id") % 9000).cast("string"), F.when(F.col("id") % 7 == 0, "").otherwise(".")).alias("text"), F.lit(1).alias("copies"),
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        (got,) = C.repair_turns(turns).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen, repair = set(), C.Repair()
    monkeypatch.setattr(C, "HELD", 4000)
    for r in sorted(turns.collect(), key=lambda r: r.turn):
        repair.add(r.turn, r.role, r.text, (r.role, r.text) in seen)
        seen.add((r.role, r.text))
    assert repair.way.file is not None and len(repair.way.held) < 4000
    assert tuple(got)[1:] == repair.row() and got.duplicate > 0 and len(got.audit) >= 20_000
