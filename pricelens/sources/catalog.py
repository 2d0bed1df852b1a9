"""Plain reads of the model's tables: what is asked reaches the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that a file, which one task sorts, holds on average; values asked for that go into a condition.
FILE_ROWS, MOST_ASKED = 500_000, 10_000


def laid_out(df: DataFrame, path: str, key: str, parts: int | None = None) -> None:
    """df as files by ranges of key, sorted within, so that a file's bounds tell whether it has a value at all. Without parts their number, 16 at least, goes by the rows; those of one key may be in several files."""
    parts = parts or max(16, -(-df.count() // FILE_ROWS))
    df.repartitionByRange(parts, F.col(key), F.xxhash64(*df.columns)).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def scan(spark: SparkSession, path: str, *columns: str, **asked) -> DataFrame:
    """Rows of path where each column asked for is the value (null for None), or one of a list of values; the columns named, or all.

    Conditions are plain comparisons, which Parquet's readers take down to row
    groups; a list is an IN. An empty list gives no rows.
    """
    df = spark.read.parquet(path)
    for name, value in asked.items():
        c = F.col(name)
        df = df.filter(c.isNull() if value is None else c.isin(*value) if isinstance(value, (list, tuple, set)) else c == value)
    return df.select(*columns) if columns else df


def scan_those(spark: SparkSession, path: str, name: str, asked: DataFrame) -> DataFrame:
    """Rows of path whose column name is one of asked (one column): up to MOST_ASKED values as scan() has them, more by a semi-join, so that they don't pass through the driver."""
    few = asked.distinct().limit(MOST_ASKED + 1).collect()
    if len(few) <= MOST_ASKED:
        return scan(spark, path, **{name: [r[0] for r in few]})
    return scan(spark, path).join(asked.select(F.col(asked.columns[0]).alias(name)).hint("merge"), name, "left_semi")


def others(df: DataFrame, **left_out) -> DataFrame:
    """Rows of df whose columns aren't the values left out; a null is no value and stays out too, as an unequal comparison has it."""
    for name, value in left_out.items():
        df = df.filter(F.col(name) != value)
    return df


def used_searches(searches: DataFrame) -> DataFrame:
    """id, platform, query of every search (id, platform, keywords), by id: its keywords as one text."""
    return searches.select("id", "platform", F.array_join("keywords", " ").alias("query")).orderBy("id")


def aliases(table: DataFrame) -> DataFrame:
    """alias of every row (product_id, alias), those of all products among them, each as often as it stands."""
    return table.select("alias")
