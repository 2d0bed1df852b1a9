"""Sinks of micro-batches that may come again: keyed tables of which a batch rewrites what it touches, and tables that only grow."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions.lineage import cut


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@dataclass(frozen=True)
class KeyedTable:
    """A table of one row a key at path, in a folder for each value of column part, which follows from the key.

    A row that comes replaces its key's, but for columns in fixed, which stay
    as they first were, in known, which are only filled where they were null,
    and in most, which never fall. Of several rows of a key in one batch the
    last by order counts.
    """

    path: str
    keys: tuple[str, ...]
    part: str
    order: str
    fixed: tuple[str, ...] = ()
    known: tuple[str, ...] = ()
    most: tuple[str, ...] = ()

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def value(self, c: str) -> Column:
        old, new = F.col(f"old.{c}"), F.col(f"new.{c}")
        if c in self.fixed:
            after = old
        elif c in self.known:
            after = F.coalesce(old, new)
        else:
            after = F.greatest(old, new) if c in self.most else new
        # a batch that is older than what stands has been here before
        return F.when(F.col("new").isNull() | (F.col("old.batch") > F.col("new.batch")), old).when(F.col("old").isNull(), new).otherwise(after).alias(c)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Takes in a batch, which carries part; again, nothing changes.

        Only folders that the batch touches are read and rewritten: each by a
        rename, so that a batch that broke off is made whole when it comes
        again. The driver gets the names of the folders that it touches.
        """
        spark = batch.sparkSession
        others = [c for c in batch.columns if c not in (*self.keys, self.part)]
        new = batch.withColumn("batch", F.lit(number).cast("long")).groupBy(*self.keys, self.part).agg(F.max_by(F.struct(*others, "batch"), self.order).alias("new"))
        new = cut(new)
        out = new.select(*self.keys, self.part, "new.*")
        touched = [r[0] for r in new.select(self.part).distinct().collect()]
        if not touched:
            return
        if exists(spark, self.path):
            old = self.rows(spark).filter(F.col(self.part).isin(touched))
            old = old.select(*self.keys, self.part, F.struct(*others, "batch").alias("old"))
            both = old.join(new, [*self.keys, self.part], "full")
            out = cut(both.select(*self.keys, self.part, *(self.value(c) for c in (*others, "batch"))))
        out.repartition(self.part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.part).parquet(self.path)


def raw_posts(path: str) -> KeyedTable:
    """Board posts by site and number: when a post appeared and where it was first found stay."""
    return KeyedTable(path, ("site", "post_id"), "part", "captured_at", fixed=("origin",), known=("posted_at",))


def poll_states(path: str) -> KeyedTable:
    """Cursors by site: the last success never goes back."""
    return KeyedTable(path, ("site",), "part", "updated_at", most=("last_successful_poll_at",))


def append_observations(path: str) -> Callable[[DataFrame, int], None]:
    """A writer of market observations: those without a price are left out and counted, others stay, repeats too; a batch that comes again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch = cut(batch)
        batch.filter(F.col("price").isNotNull()).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        batch.agg(F.count("price").alias("inserted"), F.count_if(F.col("price").isNull()).alias("skipped_no_price")).write.mode("overwrite").parquet(f"{path}/tally/batch={number}")

    return write


def sunk(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """A writer that gives each micro-batch of stream to merge, with its number."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
