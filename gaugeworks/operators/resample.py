"""Readings put on a fixed grid, or summed up by calendar period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.durations import ns
from gaugeworks.errors import RegularizeArgumentError
from gaugeworks.functions import aggregators
from gaugeworks.operators.neighbours import nearest
from gaugeworks.operators.spans import AUTO, beyond, handed, resolved

#: Seconds from the first year to 1970: grids are aligned to the former.
YEAR_ONE = 62135596800
#: Most grid points that one row unfolds to at a time.
BLOCK = 100_000


def _aggregator(agg):
    if isinstance(agg, str):
        return aggregators.aggregator(agg)
    if not callable(agg):
        raise RegularizeArgumentError("an aggregator is needed")
    return agg


def _reduced(df: DataFrame, window: list[str], agg) -> DataFrame:
    if aggregators.needs_place(agg):
        df = df.withColumn("place", F.row_number().over(Window.partitionBy(*window).orderBy("chron_ns", "seq")) - 1)
    return df.groupBy(*window).agg(agg(aggregators.Frame()).alias("meas"))


def _unfolded(df: DataFrame, start: str, stop: str, step: int, name: str) -> DataFrame:
    """``df`` once for each of start, start + step, ... up to stop, in blocks so that no array is long."""
    block = step * max(1, min(BLOCK, 2**60 // step))
    blocks = df.withColumn("__block", F.explode(F.expr(f"sequence({start}, {stop}, {block}L)")))
    return blocks.withColumn(name, F.explode(F.expr(f"sequence(__block, least(__block + {block - step}L, {stop}), {step}L)"))).drop("__block")


def ticks(df: DataFrame, step_ns: int, tolerance_ns: int = 0) -> DataFrame:
    """``df`` with tick, the grid point whose window (tick - step, tick] takes each reading.

    A reading late by at most the tolerance still belongs to the window before; the first
    window of a series is found without it.
    """
    phase = YEAR_ONE * 10**9 % step_ns
    up = lambda x: x + F.pmod(-(x + F.lit(phase)), F.lit(step_ns))
    if not tolerance_ns:  # no reading's window ends before that of the first
        return df.withColumn("tick", up(F.col("chron_ns")))
    first = df.groupBy("series_id").agg(F.min("chron_ns").alias("__first"))
    met = df.join(first, "series_id")
    return met.withColumn("tick", F.greatest(up(F.col("chron_ns") - F.lit(tolerance_ns)), up(F.col("__first")))).drop("__first")


def regularize(df: DataFrame, step: int | str, agg="mean", tolerance: int | str = 0, chunk=AUTO) -> DataFrame:
    """series_id, chron_ns, meas on every grid point from a series' first window to its last; empty windows are missing."""
    step_ns, tolerance_ns, agg = ns(step), ns(tolerance), _aggregator(agg)
    if step_ns <= 0:
        raise RegularizeArgumentError(f"step {step} isn't above zero")
    if not 0 <= tolerance_ns < step_ns:
        raise RegularizeArgumentError(f"tolerance {tolerance} isn't from zero to below the step")
    spans = resolved(df, chunk)
    full = _reduced(ticks(df, step_ns, tolerance_ns), ["series_id", "tick"], agg).withColumnRenamed("tick", "chron_ns")
    near = nearest(full.withColumn("seq", F.lit(0)), F.struct("chron_ns"), "__next", after=True, chunk=beyond(df, spans))
    spread = near.withColumn("__stop", F.coalesce(F.col("__next.chron_ns") - step_ns, F.col("chron_ns"))).select("series_id", F.col("chron_ns").alias("__start"), "__stop", "meas")
    grid = _unfolded(spread, "__start", "__stop", step_ns, "chron_ns")
    return handed(grid.select("series_id", "chron_ns", F.when(F.col("chron_ns") == F.col("__start"), F.col("meas")).alias("meas")), spans)


_PERIODS = {"daily": ("day", "interval 1 day"), "weekly": ("week", "interval 7 days"), "monthly": ("month", "interval 1 month"), "yearly": ("year", "interval 1 year")}


def _opens(day: Column, tz: Column | str) -> Column:
    """The first instant of a local day, in nanoseconds."""
    return F.unix_micros(F.to_utc_timestamp(day.cast("timestamp"), tz)) * 1000


def downscale(df: DataFrame, period: str, agg="mean", tz: str | DataFrame = "UTC", chunk=AUTO) -> DataFrame:
    """series_id, chron_ns (the last nanosecond of a period), meas for every calendar period in zone tz; weeks begin on Monday.

    tz: a zone for all series, or a frame of series_id and tz, one row a series; a series without one takes UTC. The session's time zone must be UTC. A local day that never happened has no period.
    """
    if period not in _PERIODS:
        raise RegularizeArgumentError(f"period {period!r} isn't one of {', '.join(_PERIODS)}")
    if df.sparkSession.conf.get("spark.sql.session.timeZone") != "UTC":
        raise RegularizeArgumentError("spark.sql.session.timeZone must be UTC")
    agg = _aggregator(agg)
    unit, length = _PERIODS[period]
    zones = tz if isinstance(tz, DataFrame) else None
    zone = tz if zones is None else F.col("__tz")
    if zones is not None:
        known = zones.select("series_id", F.col("tz").alias("__tz"))
        df = df.join(known, "series_id", "left").withColumn("__tz", F.coalesce("__tz", F.lit("UTC")))
    keys = ["series_id", *(["__tz"] if zones is not None else [])]
    # Floor division by hand: an instant before 1970 must not round up.
    micros = F.expr("timestamp_micros((chron_ns - pmod(chron_ns, 1000L)) div 1000L)")
    day = F.to_date(F.from_utc_timestamp(micros, zone))
    start = day if unit == "day" else F.trunc(day, unit)
    full = _reduced(df.withColumn("__start", start), [*keys, "__start"], agg)
    keyed = full.withColumn("chron_ns", F.unix_date("__start").cast("long") * 86400 * 10**9).withColumn("seq", F.lit(0))
    near = nearest(keyed, F.struct("__start"), "__next", after=True, chunk=beyond(df, resolved(df, chunk)))
    spread = near.withColumn("__p", F.explode(F.expr(f"sequence(__start, coalesce(date_sub(__next.__start, 1), __start), {length})")))
    out = spread.withColumn("__open", _opens(F.col("__p"), zone)).withColumn("__close", _opens(F.expr(f"cast(__p + {length} as date)"), zone))
    return out.filter("__close > __open").select("series_id", (F.col("__close") - 1).alias("chron_ns"), F.when(F.col("__p") == F.col("__start"), F.col("meas")).alias("meas"))


def downscale_daily(df, agg="mean", tz="UTC"):
    return downscale(df, "daily", agg, tz)


def downscale_weekly(df, agg="mean", tz="UTC"):
    return downscale(df, "weekly", agg, tz)


def downscale_monthly(df, agg="mean", tz="UTC"):
    return downscale(df, "monthly", agg, tz)


def downscale_yearly(df, agg="mean", tz="UTC"):
    return downscale(df, "yearly", agg, tz)
