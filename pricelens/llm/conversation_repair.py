"""Conversation repair: the cheapest edits that make a conversation's roles alternate.

Turns are sorted within their conversation by the shuffle; workers walk them in
order and carry the dynamic programme's state from one Arrow batch to the next.
A state says which role came last; of each state the cheapest edits so far are
known by cost, rank among the states, and a running hash of the repaired text.
How a state was reached is a byte a turn, and goes to a file once a conversation
has very many of them, so a conversation of any length is held in bounded memory
but for its own audit.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
#: States: nothing yet, system, user or assistant came last; the conversation may end in ENDS. Which role comes next but for a system turn at the start.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
BLANKS = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}
#: Bytes of one conversation's way back (four a turn) that are held in memory before they go to a file.
HELD = 8 << 20
UNREACHED = 255


def after(state: int, initial: str) -> int | None:
    """The state after a turn of that role, None where the turn can't stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if initial and initial == NAMES[NEXT[state]][0] else None


def ways(initial: str, deleted: bool, extra: int) -> list[tuple[int, int, int, str]]:
    """(state, next state, cost, edits) of one turn: insertions before it, then an edit of it, which costs extra unless it deletes; of two that lead from one state to another only the better.

    Insertions before a deletion are left out: after it they cost the same and read less.
    """
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for state in range(4):
        found = [(state, DELETE, "D")]
        at = state
        for n in range(0 if deleted else 3):
            to = after(at, initial)
            found += [] if to is None else [(to, KEEP + n * INSERT + extra, n * "I" + "K")]
            found.append((NEXT[at], REROLE + n * INSERT + extra, n * "I" + "R"))
            at = NEXT[at]
        for to, cost, edits in found:
            best[state, to] = min(best.get((state, to), (cost, edits)), (cost, edits))
    return [(state, to, cost, edits) for (state, to), (cost, edits) in sorted(best.items())]


WAYS = {(initial, deleted, extra): ways(initial, deleted, extra) for initial in ("s", "u", "a", "") for deleted in (False, True) for extra in (0, TRUNCATED)}
#: Insertions at the end, by state.
LAST = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
EDITS = ["D", "K", "IK", "IIK", "R", "IR", "IIR"]


class WayBack:
    """A code for each state and turn: the state before it and the edits, as 8 * edits + state; read from the end."""

    def __init__(self):
        self.held, self.file, self.rows = bytearray(), None, 0

    def add(self, codes: bytes) -> None:
        self.held += codes
        self.rows += 1
        if len(self.held) >= HELD:
            self.file = self.file or tempfile.TemporaryFile()  # this task's own, gone with it
            self.file.write(self.held)
            self.held = bytearray()

    def backwards(self) -> Iterator[bytes]:
        parts = [(None, self.held)] + ([(a, None) for a in reversed(range(0, self.file.tell(), HELD))] if self.file else [])
        end = self.file.tell() if self.file else 0
        for at, block in parts:
            if block is None:
                self.file.seek(at)
                block = self.file.read(min(HELD, end - at))
            for i in range(len(block) - 4, -1, -4):
                yield block[i : i + 4]

    def edits(self, state: int) -> str:
        out = bytearray()
        for codes in self.backwards():
            edits = EDITS[codes[state] >> 3]
            out += edits[::-1].encode()
            state = codes[state] & 7
        out.reverse()
        if self.file:
            self.file.close()
        return out.decode()


class Repair:
    """One conversation's state while its turns go by."""

    def __init__(self):
        self.states = {START: (0, 0, hashlib.sha256())}  # cost, rank of the edits so far, hash of the text so far
        self.way = WayBack()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last = self.turn = self.first_turn = None
        self.turns, self.initial = 0, None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        """A turn after the damage; seen: an earlier turn number has its role and text."""
        if turn is not None and turn != self.turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turn, self.turns = turn, self.turns + 1
        seen = seen or self.last == (turn, role, text)
        self.last = (turn, role, text)
        shown = text.strip(BLANKS)
        blank, duplicate, truncated = not shown, bool(shown) and seen, bool(shown) and not seen and shown[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        self.step(initial if initial in ("s", "u", "a") else "", blank or duplicate, TRUNCATED * truncated, role, text)

    def step(self, initial: str, deleted: bool, extra: int, role: str, text: str) -> None:
        best = {}
        for state, to, cost, edits in WAYS[initial, deleted, extra]:
            if state in self.states:
                so_far, rank, _ = self.states[state]
                way = (so_far + cost, rank, edits, state)
                if to not in best or way < best[to]:
                    best[to] = way
        order = {to: i for i, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
        codes, new = bytearray([UNREACHED] * 4), {}
        for to, (cost, _, edits, state) in best.items():
            codes[to] = EDITS.index(edits) << 3 | state
            new[to] = (cost, order[to], told(self.states[state][2], state, edits, role, text))
        self.states = new
        self.way.add(codes)

    def row(self) -> tuple:
        cost, _, edits, state = min((cost + INSERT * len(LAST[state]), rank, LAST[state], state) for state, (cost, rank, _) in self.states.items())
        digest = told(self.states[state][2], state, edits, "", "").hexdigest()
        gaps = 0 if self.turn is None else self.turn - self.first_turn + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, self.way.edits(state) + edits, digest


def told(sha, state: int, edits: str, role: str, text: str):
    """The hash after edits of one turn, which begin at state."""
    if edits == "D" or not edits:
        return sha
    sha = sha.copy()
    for e in edits:
        if e == "I" or e == "R":
            at = NEXT[state]
            line = f"{NAMES[at]}:{'' if e == 'I' else text}"
        else:
            at, line = after(state, role[:1]), f"{role}:{text}"
        sha.update(line.encode() if state == START else b"\n" + line.encode())
        state = at
    return sha


RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each conversation of frames (conv, numbered, turn, role, text, copies, seen), which come sorted; one is carried from frame to frame."""
    now, repair = None, None
    for frame in frames:
        out = []
        rows = zip(*(frame[c].tolist() for c in ("conv", "numbered", "turn", "role", "text", "copies", "seen")))
        for conv, group in groupby(rows, key=lambda r: r[0]):
            if repair is None or conv != now:
                out += [(now, *repair.row())] if repair else []
                now, repair = conv, Repair()
            for _, numbered, turn, role, text, copies, seen in group:
                for _ in range(copies):
                    repair.add(turn if numbered else None, role, text, seen)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
    if repair:
        yield pd.DataFrame([(now, *repair.row())], columns=[c.split()[0] for c in RESULT.split(", ")])


def damaged(turns: DataFrame, conv: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """conv (text), numbered, turn, role, text and copies (0: dropped) of each turn, by the checksum of conv:turn; nulls are one space, a null turn stays one."""
    some = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some(conv), F.lit(":"), some(turn))) % 20
    text_ = F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(some(text), "[.!?]", "")).otherwise(some(text))
    return turns.select(
        conv.cast("string").alias("conv"), turn.isNotNull().alias("numbered"), F.coalesce(turn, F.lit(0)).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(some(role)).alias("role"), text_.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def repair_turns(df: DataFrame) -> DataFrame:
    """The result of each conversation of df (conv, numbered, turn, role, text, copies).

    Which turns repeat an earlier one is found by minima over hashes of
    conversation, role and text, so no task remembers what it has seen; turns
    of one number are told by their neighbours in the order.
    """
    key = F.sha2(F.to_json(F.struct("conv", "role", "text"), {"ignoreNullFields": "false"}), 256)
    df = df.withColumn("key", F.unhex(key))
    place = F.struct("numbered", "turn")
    first = df.filter("copies > 0").groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first")
    df = df.join(first, "key", "left").withColumn("seen", F.coalesce(F.col("first") < place, F.lit(False)))
    df = df.select("conv", "numbered", "turn", "role", "text", "copies", "seen").repartition("conv").sortWithinPartitions("conv", "numbered", "turn", "role", "text")
    return df.mapInPandas(repaired, RESULT)


def repair_conversations(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation of turns, after the damage of damaged().

    Turns go by number, those without one first, ties by role, then text; a null
    conv_id is a conversation like any other, a null role or text one space. A
    role counts by its first character; an empty one can't stand. Of edits of one cost the audit that is
    least in ASCII wins. Repeated rows are turns; other columns, whatever their
    names, play no part; no turns give no rows. One task walks a conversation,
    in bounded memory but for the audit's own text.
    """
    df = damaged(turns, *(F.col(c) for c in (conv_col, turn_col, role_col, text_col)))
    kind = turns.schema[conv_col].dataType
    return repair_turns(df).select(F.col("conv").cast(kind).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


#: CRC-32 of an ASCII name, bit by bit: SQL has no function for it.
CRC = "xor(list_reduce([ascii(b) FOR b IN string_split(name, '')], lambda c, b: list_reduce(range(8), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, CAST(b AS BIGINT))), CAST(4294967295 AS BIGINT)), 4294967295)"


def sql() -> str:
    """The states as a list of structs, which list_reduce takes from turn to turn: (c cost, a edits, r repaired text)."""
    none = "{'c': 1000000000, 'a': '', 'r': ''}"
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"

    def way(state: int, cost: str, edits: str, said: str = "''", where: str = "true") -> str:
        return f"{{'c': CASE WHEN {where} THEN least(s[{state}].c + {cost}, 1000000000) ELSE 1000000000 END, 'a': s[{state}].a || '{edits}', 'r': s[{state}].r || {said}}}"

    kept, again = "chr(10) || x.role || ':' || x.text", "|| x.text"
    free = "NOT x.gone"
    is_ = lambda c: f"{free} AND x.i = '{c}'"
    drop = [way(k, "3", "D") for k in (1, 2, 3, 4)]
    to_user = [w for k in (1, 2, 4) for w in (way(k, "0 + x.t", "K", kept, is_("u")), way(k, "2 + x.t", "R", user + again, free))]
    to_user += [way(3, "2 + x.t", "IK", f"{assistant} || {kept}", is_("u")), way(3, "4 + x.t", "IR", f"{assistant} || {user}{again}", free)]
    to_assistant = [way(3, "0 + x.t", "K", kept, is_("a")), way(3, "2 + x.t", "R", assistant + again, free)]
    to_assistant += [w for k in (1, 2, 4) for w in (way(k, "2 + x.t", "IK", f"{user} || {kept}", is_("a")), way(k, "4 + x.t", "IR", f"{user} || {assistant}{again}", free))]
    # two insertions before a turn lead back to what a turn of the other role needs
    to_user += [way(k, "4 + x.t", "IIK", f"{user} || {assistant} || {kept}", is_("u")) for k in (1, 2, 4)]
    to_assistant += [way(3, "4 + x.t", "IIK", f"{assistant} || {user} || {kept}", is_("a"))]
    to_system = [way(1, "0 + x.t", "K", kept, is_("s"))]
    step = ", ".join(f"list_min([{', '.join(w)}])" for w in ([drop[0]], [drop[1], *to_system], [drop[2], *to_user], [drop[3], *to_assistant]))
    last = ", ".join([way(1, "0", ""), way(2, "4", "II", f"{user} || {assistant}"), way(3, "2", "I", assistant), way(4, "0", "")])
    return rf"""
WITH d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), k AS (SELECT *, {CRC} % 20 AS kind FROM d),
r AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role0 END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text
  FROM k, range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END) AS c(copy)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS mark, substr(role, 1, 1) AS i FROM r
), f AS (
  SELECT *, mark = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS was FROM n
), g AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen) AS duplicate,
    count(*) FILTER (NOT blank AND NOT seen AND mark NOT IN ('.', '!', '?')) AS truncated, count(*) FILTER (was IS NOT NULL AND was || i NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'role': role, 'text': text, 'i': i, 'gone': blank OR seen, 't': CASE WHEN NOT blank AND NOT seen AND mark NOT IN ('.', '!', '?') THEN 1 ELSE 0 END}} ORDER BY pos) AS rows
  FROM f GROUP BY conv_id
), s AS (SELECT * EXCLUDE (rows), list_reduce(rows, lambda s, x: [{step}], [{{'c': 0, 'a': '', 'r': ''}}, {none}, {none}, {none}]) AS s FROM g),
e AS (SELECT * EXCLUDE (s), list_min([{last}]) AS best FROM s)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


OP13_SQL = sql()
