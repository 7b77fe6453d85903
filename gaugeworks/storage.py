"""Intermediate tables in the folder that driver and executors share, and joins that a frequent key doesn't stop."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where the session names none and all tasks run on this machine a folder of our own is set;
    on a cluster that would be a folder that executors don't share, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that its lineage ends there.

    The files stay until the shared folder is cleared: a later stage may have to read them
    again after it loses an executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    The caller passes a stored or cheap frame: it is counted. Beyond the bound Spark joins
    by shuffling both sides.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
#: A key of fewer rows is never told apart as hot.
HOT_LEAST = 1_000


def keyed_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", by: list[str] | None = None, counted: DataFrame | None = None) -> DataFrame:
    """``left`` joined to ``right``, which has at most one row for each key, without a key of many rows of
    ``left`` becoming one task's.

    A key is hot if it has more than twice an even share of the rows; so there are at most half as many hot keys as
    shuffle partitions. The rows of a hot key are dealt by a hash of ``by`` (all columns, if not given; maps can't be hashed)
    to as many parts as it has shares, and its row of ``right`` goes to each: all in all at most as many copies as there are
    partitions. how: inner or left. Null keys find nothing. Keys are counted in ``counted`` (``left``, if not given): pass
    a stored or cheap frame, or a stored ``right`` with the counts as __rows (dropped here).
    """
    spark, tasks = left.sparkSession, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "__rows" in right.columns:
        counts, right = right.select(*on, "__rows"), right.drop("__rows")
        total = counts.agg(F.sum("__rows")).first()[0] or 0
    else:
        counted = left if counted is None else counted
        counts, total = counted.groupBy(*on).agg(F.count("*").alias("__rows")), counted.count()
    least = max(HOT_LEAST, 2 * total // tasks)
    hot = counts.filter(F.col("__rows") > least).select(*on, F.expr(f"cast(2 * __rows div {least} as int)").alias("__parts"))
    rows = hot.collect()  # at most half as many as there are partitions
    if not rows:
        return left.join(right, on, how)
    hot = F.broadcast(spark.createDataFrame(rows, hot.schema))
    dealt = F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(*(by or left.columns)), F.col("__parts")).cast("int")).otherwise(F.lit(0))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    salted = left.join(hot, on, "left").withColumn("__salt", dealt).drop("__parts")
    return salted.join(right.join(hot, on, "left").withColumn("__salt", copies).drop("__parts"), [*on, "__salt"], how).drop("__salt")


