"""Intermediate tables that outlive executors, and distributed running totals.

Iterative or multi-pass operators cut lineage by writing a Parquet table into
the shared folder named by ``spark.checkpoint.dir``. Only where that setting is
absent (tests on one machine) a local temporary folder stands in.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_folders: set[str] = set()  # local and file: folders to be removed at exit
_temporary: list[str] = []


def _forget() -> None:
    for path in _folders:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_forget)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables of this application, as a URI or path."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        folder = f"{base.rstrip('/')}/graphloom-{spark.sparkContext.applicationId}"
        if base.startswith(("file:", "/")):
            _folders.add("/" + folder.removeprefix("file:").lstrip("/"))
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    if not _temporary:
        _temporary.append(tempfile.mkdtemp(prefix="graphloom-"))
        _folders.add(_temporary[0])
    return _temporary[0]


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that still read them become unusable."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write `df` once and return a reader of the written table (lineage ends there)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    """Number of shuffle tasks the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add `name`: the inclusive sum of `value` over the rows of the same `keys` up to this row in `order`.

    A window over `keys` alone would put a hot key into a single task. Instead the
    rows are range-partitioned by keys and order, every task sums its own slice,
    and one row per (task, key) carries the slice totals that precede it. A null
    key is a key of its own, nulls in `order` come first; rows that tie in keys and
    order get an arbitrary order among themselves.
    """
    tasks = task_count(df.sparkSession)
    sliced = materialize(df.repartitionByRange(tasks, *keys, *order).withColumn("_slice", F.spark_partition_id()))
    totals = sliced.groupBy("_slice", *keys).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    same = ["_slice", *keys]
    before = totals.select(
        *[F.col(k).alias(f"_of_{k}") for k in same], F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")
    )
    matching = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in same])
    within = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.withColumn("_within", F.sum(value).over(within))
        .join(before, matching)
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_slice", "_before", "_within", *[f"_of_{k}" for k in same])
    )
