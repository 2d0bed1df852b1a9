"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, as written and read again; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.llm.common import saved, ship, table, unused
from pricelens.llm.decontaminate import leaks
from pricelens.llm.language_id import UNKNOWN, tag_languages, train
from pricelens.llm.minhash_dedup import near_duplicates
from pricelens.llm.packing import pack, public_tokenizer
from pricelens.llm.pii import redact

#: Texts of which no language has this share of the words are in none.
LEAST_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts among them) and those of which no known language has LEAST_SHARE of the words.

    Learns from all rows that have a language; a null id is an id like others,
    repeated rows are judged alike, and other columns pass through whatever
    their names. Of an empty table nothing is learned and nothing kept.
    """
    ship(spark)
    crf = train(docs, "doc_id", "text", "lang", F.lit(True))
    (told,) = unused(docs.columns, "told")
    tagged = docs.withColumn(told, tag_languages(docs, crf, "text"))
    return tagged.filter((F.col(told)["lang_pred"] != UNKNOWN) & (F.col(told)["score"] >= LEAST_SHARE)).select(*docs.columns)


def row_key() -> Column:
    """256 bits of id and text, never null: ids may be absent, or stand on several texts. An id's text has no line break, and the marks tell a null from a value."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(mark("doc_id"), F.lit("\n"), mark("text")), 256))


def short_key(key: Column) -> Column:
    """63 bits of a row key, never negative."""
    return F.shiftrightunsigned(F.xxhash64(key), 1)


def numbered(docs: DataFrame, number: str) -> DataFrame:
    """docs and a long for each row, alike for rows alike in id and text and for no others.

    It is the short key; where one stands for several row keys, which are few
    however many the rows, each of these has a negative number of its own.
    """
    key, own = unused([*docs.columns, number], "key", "own")
    keyed = docs.withColumn(key, row_key()).withColumn(number, short_key(F.col(key)))
    shared = keyed.groupBy(number).agg(F.min(key).alias("least"), F.max(key).alias("most")).filter("least <> most").select(number)
    several = keyed.select(key, number).join(F.broadcast(shared), number, "left_semi").select(key).distinct()
    several = saved(several.select(key, (-F.row_number().over(Window.orderBy(key))).cast("long").alias(own)), "keys")
    return keyed.join(F.broadcast(several), key, "left").withColumn(number, F.coalesce(own, number)).select(*docs.columns, number)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of least id, one without an id only if none has an id.

    A document is an id (or none) with a text: rows alike in both become one,
    several texts of one id are judged each by itself. Null and empty texts are
    like no others. Other columns pass through, whatever their names; of rows
    alike in id and text, which differ in others, the least stays, by the text
    of the others in their order, a null before all.
    """
    ship(spark)
    (key,) = unused([*docs.columns, "component_id"], "row_key")
    keyed = numbered(docs, key)
    groups = near_duplicates(keyed, size=5, num=80, den=100, id_col=key).select(F.col("doc_id").alias(key), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("key"))
    kept = groups.join(keyed.select(key, "doc_id"), key).groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.key").alias(key))
    others = [x for c in docs.columns if c not in ("doc_id", "text") for x in (F.col(c).isNotNull(), F.col(c).cast("string"))]
    least = F.min_by(F.struct(*docs.columns), F.struct(F.lit(0), *others))
    return keyed.join(kept, key, "left_semi").groupBy(key).agg(least.alias("row")).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item, with or without an id; other texts of the same id stay.

    Null and empty texts hold none and stay, repeated rows stay or go together,
    other columns pass through whatever their names; an empty benchmark drops
    nothing.
    """
    ship(spark)
    (key,) = unused(docs.columns, "row_key")
    keyed = docs.withColumn(key, row_key())
    found = leaks(keyed, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(found, key, "left_anti").select(*docs.columns)


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a span's kind in place of each span of personal data; n_chars follows, null for a null text.

    Every row stays, repeated ones alike; other columns pass through, whatever
    their names.
    """
    ship(spark)
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, their ids among the columns; a null or empty text is its end token, repeated rows are documents of their own, and no documents give no pieces."""
    ship(spark)
    return pack(docs, public_tokenizer())


STAGES = [("language", language), ("deduplicate", deduplicate), ("decontaminate", decontaminate), ("remove_pii", remove_pii), ("packing", packing)]

#: No SQL expresses a learned model, so tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
