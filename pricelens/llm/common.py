"""What the operators of this subpackage share."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word definitions have it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which every executor sees.

    Where the setting is absent, a temporary folder of this machine takes its
    place if driver and executors are one process (local tests); on a cluster
    its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = os.path.dirname(known) if known else f"file://{tempfile.mkdtemp(prefix='pricelens-')}"
        if not known:
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % n, F.lit(0))


def unused(names: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores in front as make it differ from all names (Spark's don't differ by case)."""
    taken = {n.lower() for n in names}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        out.append(w)
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of value, which is worked out once for a row however often use names it, within functions over arrays too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_runs(c: Column, size: int = 64) -> Column:
    """An array as arrays of size items; one empty array of an empty one."""
    return let(c, lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(c) - 1) / size).cast("int"), F.lit(0))), lambda k: F.slice(c, k * size + 1, F.lit(size))))


def lower_ascii(col):
    return F.translate(col, UPPER, LOWER)


def ship(spark: SparkSession) -> None:
    """Gives the package to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_pricelens_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    to = os.path.join(tempfile.mkdtemp(prefix="pricelens-"), "pricelens.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "pricelens")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    sc.addPyFile(to)
    sc._pricelens_shipped = True


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run
