"""Chat formatting with Spark expressions only.

    <|user|>first turn<|turn|>next turn of the same role<|end|><|assistant|>...<|end|>

Adjacent turns of one role share a block. In texts and roles "\\" becomes "\\s"
and "<" becomes "\\l", in roles "|" becomes "\\p", so no control string can stand
in them, and the way back is exact. The loss mask covers the texts of assistant turns, not their marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_runs, query, table

OPEN, SHUT, TURN, END = "<|", "|>", "<|turn|>", "<|end|>"
LEARNED = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    """Every "\\" of an escaped text begins an escape, so "\\l" first and "\\s" after it is exact."""
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    """As escape, and "|" as "\\p": the first "|>" ends a role's mark."""
    return F.replace(escape(c), F.lit("|"), F.lit("\\p"))


def format_chats(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv_id, formatted, loss_spans: one row per conversation.

    Turns go by turn number (null first), ties by role, then text; repeated
    rows are turns of their own. Null roles and texts count as empty, a null
    conv_id is a conversation like any other; other columns play no part.
    loss_spans lists (start, length) in formatted, as code points from 0, of
    the escaped text of each assistant turn. A conversation is one output row,
    so one task holds it whole; the shuffle carries each turn once.
    """
    item = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = turns.select(F.col(conv_col).alias("conv_id"), item.alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    df = df.select("conv_id", "xs", F.transform("xs", lambda x: x["role"]).alias("roles"), F.transform("xs", lambda x: escape(x["text"])).alias("texts"))
    # where a block of one role begins
    df = df.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("xs") - 1), lambda i: (i == 0) | (F.get("roles", i) != F.get("roles", i - 1))))
    last = lambda k: F.coalesce(F.get("starts", k + 1), F.size("xs"))
    body = lambda s, k: F.array_join(F.slice("texts", s + 1, last(k) - s), TURN)
    block = lambda s, k: F.concat(F.lit(OPEN), escape_role(F.get("roles", s)), F.lit(SHUT), body(s, k), F.lit(END))
    df = df.withColumn("blocks", F.transform("starts", block)).withColumn("formatted", F.array_join("blocks", ""))
    # a turn's mark: the block's opening at its first turn, else TURN, preceded by END where a block ended
    mark = lambda i: F.when(i == 0, F.length(escape_role(F.get("roles", i))) + 4).when(F.get("roles", i) != F.get("roles", i - 1), F.length(escape_role(F.get("roles", i))) + 4 + len(END)).otherwise(len(TURN))
    step = F.transform(F.sequence(F.lit(0), F.size("xs") - 1), lambda i: F.struct(mark(i).cast("long").alias("mark"), F.length(F.get("texts", i)).cast("long").alias("n"), (F.get("roles", i) == LEARNED).alias("learned")))
    # positions add up by runs of turns, then within each: appending to one array for thousands of turns would take time with their square
    df = df.withColumn("runs", in_runs(step))
    long = lambda x: x["mark"] + x["n"]
    starts = F.aggregate("runs", F.array(F.lit(0).cast("long")), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + long(x)))))
    df = df.withColumn("at", starts)
    zero = lambda at: F.struct(at.alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    walk = lambda r, i: F.aggregate(r, zero(F.get("at", i)), lambda acc, x: F.struct(
        (acc["at"] + long(x)).alias("at"),
        F.when(x["learned"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["mark"]).alias("start"), x["n"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
    ))["spans"]
    return df.select("conv_id", "formatted", F.flatten(F.transform("runs", walk)).alias("loss_spans"))


def masked(formatted: Column, spans: Column) -> Column:
    """The texts under spans, unescaped and joined; a run of spans is cut out first, so that no text is walked once for each."""
    first = lambda r: F.get(r, F.lit(0))["start"]
    end = lambda r: F.element_at(r, -1)["start"] + F.element_at(r, -1)["length"]
    part = lambda r: F.substring(formatted, (first(r) + 1).cast("int"), (end(r) - first(r)).cast("int"))
    cut = lambda r: F.struct(r.alias("r"), part(r).alias("text"))
    text = lambda x: F.array_join(F.transform(x["r"], lambda s: unescape(F.substring(x["text"], (s["start"] - first(x["r"]) + 1).cast("int"), s["length"].cast("int")))), "")
    return F.when(F.size(spans) > 0, F.array_join(F.transform(F.transform(in_runs(spans), cut), text), "")).otherwise("")


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Turns beside all other columns: role, text and whether the loss mask covers
    the text, of each turn in order, read back from column formatted alone.
    Null or empty formatted gives null or no turns."""
    blocks = F.filter(F.split("formatted", r"\Q<|end|>\E", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        shut = F.instr(b, SHUT)
        role = unescape(F.replace(F.substring(b, 3, shut - 3), F.lit("\\p"), F.lit("|")))
        return F.transform(F.split(F.substring(b, shut + 2, F.length(b)), r"\Q<|turn|>\E", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"), (role == LEARNED).alias("learned")))

    return formatted.select("*", F.flatten(F.transform(blocks, turns)).alias("turns"))


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    df = parse_chats(format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    df = df.withColumn("loss", masked(F.col("formatted"), F.col("loss_spans")))
    return df.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Ties as in format_chats; the marks' lengths: 4 + the role + 7 for a block, 8 between turns of one.
OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), w AS (
  SELECT *, row_number() OVER o AS n, lag(role) OVER o AS was, replace(replace(text, '\', '\s'), '<', '\l') AS e, replace(replace(replace(role, '\', '\s'), '<', '\l'), '|', '\p') AS r
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256,
  CAST(sum(length(e) + CASE WHEN was IS NULL OR was <> role THEN 11 + length(r) ELSE 8 END) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""
