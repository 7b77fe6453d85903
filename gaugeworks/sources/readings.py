"""Readings: rows (series_id string, seq long, chron_ns long, meas double).

seq is the order of arrival, which settles equal instants. Instants are nanoseconds since 1970 in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.operators.neighbours import ranked
from gaugeworks.operators.ranks import span_table
from gaugeworks.operators.spans import AUTO, SPAN, assigned, resolved

SCHEMA = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("chron_ns", T.LongType()), T.StructField("meas", T.DoubleType())])
KEY = ("series_id", "chron_ns", "seq")


def instant_ns(ts: Column | str) -> Column:
    """Nanoseconds of a timestamp (microseconds long), without time zone or in UTC."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")) * 1000


def readings(df: DataFrame, series: Column | str, instant: Column | str, value: Column | str, order: Column | str | list) -> DataFrame:
    """Readings from any table. instant: a timestamp, or a long of nanoseconds; order: a long column that
    gives the order of arrival, or a list of columns that give it together (numbered within each series and instant)."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    base = df.select(col(series).cast("string").alias("series_id"), *([] if isinstance(order, list) else [col(order).cast("long").alias("seq")]), *([F.struct(*map(col, order)).alias("__order")] if isinstance(order, list) else []), col(instant).alias("__at"), col(value).cast("double").alias("meas"))
    at = F.col("__at") if isinstance(base.schema["__at"].dataType, T.LongType) else instant_ns("__at")
    base = base.withColumn("chron_ns", at)
    if isinstance(order, list):
        base = base.withColumn("seq", F.row_number().over(Window.partitionBy("series_id", "chron_ns").orderBy("__order")).cast("long"))
    return base.select(*SCHEMA.names)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def from_rows(spark: SparkSession, points: list[tuple[int, float | None]], series: str = "s") -> DataFrame:
    """A series from (chron_ns, meas) in order of arrival; for tests and small inputs."""
    return spark.createDataFrame([(series, i, at, None if m is None else float(m)) for i, (at, m) in enumerate(points)], SCHEMA)


def append(readings_: DataFrame, batch: DataFrame) -> DataFrame:
    """Adds a batch in any order; on equal instants it comes after what was there. seq of the batch is
    moved behind the greatest of its series."""
    top = readings_.groupBy("series_id").agg(F.max("seq").alias("__top"))
    low = batch.groupBy("series_id").agg(F.min("seq").alias("__low"))
    shift = low.join(top, "series_id").select("series_id", (F.col("__top") + 1 - F.col("__low")).alias("__shift"))
    moved = batch.join(shift, "series_id", "left").withColumn("seq", F.col("seq") + F.coalesce("__shift", F.lit(0)))
    return readings_.select(*SCHEMA.names).unionByName(moved.select(*SCHEMA.names))


def time_range(readings_: DataFrame, start_ns: int, end_ns: int, margin_ns: int = 0) -> DataFrame:
    """Readings from start to end and a margin on both sides, so that neighbours at the edges are still seen."""
    return readings_.filter(F.col("chron_ns").between(start_ns - margin_ns, end_ns + margin_ns))


def length(readings_: DataFrame) -> DataFrame:
    return readings_.groupBy("series_id").agg(F.count("*").alias("len"))


def ends(readings_: DataFrame) -> DataFrame:
    """The first and last reading of every series."""
    key, point = F.struct("chron_ns", "seq"), F.struct("chron_ns", "meas")
    return readings_.groupBy("series_id").agg(F.min_by(point, key).alias("first"), F.max_by(point, key).alias("last"))


def at(readings_: DataFrame, i: int, chunk=AUTO) -> DataFrame:
    """The i-th reading, from 0, of every series that has it. Only readings of the spans that hold it are sorted."""
    spans = resolved(readings_, chunk)
    holds = span_table(readings_, spans).filter((F.col("before") <= i) & (F.col("before") + F.col("n") > i))
    holds = holds.select(F.col("series_id").alias("__id"), F.col(SPAN).alias("__at"), "before")
    met = assigned(readings_, spans).join(holds, F.col("series_id").eqNullSafe(F.col("__id")) & F.col(SPAN).eqNullSafe(F.col("__at")))
    place = F.row_number().over(Window.partitionBy("series_id", SPAN).orderBy("chron_ns", "seq")) - 1
    return met.withColumn("__i", place + F.col("before")).filter(F.col("__i") == i).select(*readings_.columns)


#: Most readings that one row's arrays hold.
PART_ROWS = 1_000_000


def parts(readings_: DataFrame, columns: dict[str, Column], rows: int = PART_ROWS, chunk=AUTO) -> DataFrame:
    """series_id, part (from 0), and an array for each of ``columns``, in order: a series becomes rows of at most ``rows`` readings."""
    placed = ranked(readings_, chunk, "__i").withColumn("part", F.expr(f"__i div {rows}"))
    packed = F.array_sort(F.collect_list(F.struct("__i", *(c.alias(name) for name, c in columns.items()))))
    return placed.groupBy("series_id", "part").agg(packed.alias("p")).select("series_id", "part", *(F.col("p")[n].alias(n) for n in columns))


def measurements(readings_: DataFrame, rows: int = PART_ROWS, chunk=AUTO) -> DataFrame:
    """All measurements of each series in order, gaps included, in arrays: series_id, part, meas."""
    return parts(readings_, {"meas": F.col("meas")}, rows, chunk)
