"""A signal kept as its changes, restored from them, and watched for silence."""

from __future__ import annotations

from math import isnan

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.durations import ns
from gaugeworks.errors import AlarmArgumentError, RegularizeArgumentError
from gaugeworks.operators.deadband import deadband
from gaugeworks.operators.neighbours import Look, around, nearest
from gaugeworks.operators.spans import AUTO, handed, kept, resolved


def reduce(df: DataFrame, chunk=AUTO) -> DataFrame:
    """First, last, and every reading that differs from the one before; missing, broken and numbers are three classes."""
    here, spans = F.struct("meas"), resolved(df, chunk)
    near = around(df, [Look("__before", here), Look("__after", here, after=True)], spans)
    same = F.col("meas").eqNullSafe(F.col("__before.meas"))
    keep = F.col("__before").isNull() | F.col("__after").isNull() | ~same
    return handed(near.filter(keep).select(*df.columns), spans)


def reduce_with_deadband(df: DataFrame, band: float, chunk=AUTO) -> DataFrame:
    """First, last, and every reading further than ``band`` from the last one kept, or of another class.

    What is kept depends on what was kept before, along the whole series; see ``operators.deadband`` for how long series are many tasks' work.
    """
    if isnan(band) or band < 0:
        raise RegularizeArgumentError(f"band {band} is negative or NaN")
    spans = resolved(df, chunk)
    return handed(deadband(df, float(band), spans), spans)


def expand(df: DataFrame, start_ns: int, end_ns: int, step: int | str, chunk=AUTO) -> DataFrame:
    """series_id, chron_ns, meas at start, start + step, ... up to end: what the last reading up to then said.

    Missing before the first reading and after the last. A series without readings doesn't appear.
    """
    from gaugeworks.operators.resample import _unfolded

    step_ns = ns(step)
    if step_ns <= 0:
        raise RegularizeArgumentError(f"step {step} isn't above zero")
    if end_ns < start_ns:
        raise RegularizeArgumentError("the end lies before the start")
    spans = resolved(df, chunk)
    near = nearest(df.select("series_id", "seq", "chron_ns", "meas", *kept(spans)), F.struct("chron_ns"), "__next", after=True, chunk=spans)
    # A reading is held at the ticks from its own instant to before the next reading's; the last one at a tick of its own instant only.
    tick = lambda t: t + F.pmod(F.lit(start_ns) - t, F.lit(step_ns))
    first = F.greatest(F.lit(start_ns), tick(F.col("chron_ns"))).cast("long")
    last = F.least(F.lit(end_ns), F.when(F.col("__next").isNull(), F.col("chron_ns")).otherwise(F.col("__next.chron_ns") - 1)).cast("long")
    held = near.select("series_id", "meas", first.alias("__a"), last.alias("__b"))
    said = _unfolded(held.filter("__a <= __b"), "__a", "__b", step_ns, "chron_ns").select("series_id", "chron_ns", "meas")
    # Ticks before a series' first reading and after its last.
    around_ = df.groupBy("series_id").agg(F.min("chron_ns").alias("__first"), F.max("chron_ns").alias("__last"))
    end = F.lit(end_ns).cast("long")
    before = around_.select("series_id", F.lit(start_ns).cast("long").alias("__a"), F.least(end, F.col("__first") - 1).alias("__b"))
    after = around_.select("series_id", F.greatest(F.lit(start_ns), tick(F.col("__last") + 1)).cast("long").alias("__a"), end.alias("__b"))
    silent = _unfolded(before.unionByName(after).filter("__a <= __b"), "__a", "__b", step_ns, "chron_ns")
    return handed(said.unionByName(silent.select("series_id", "chron_ns", F.lit(None).cast("double").alias("meas"))), spans)


def mark_silences(df: DataFrame, max_gap: int | str, chunk=AUTO) -> DataFrame:
    """Readings, and a missing one at max_gap after each reading that the next one lets wait longer; not after a missing one."""
    gap = ns(max_gap)
    if gap <= 0:
        raise AlarmArgumentError(f"a silence of {max_gap} isn't above zero")
    spans = resolved(df, chunk)
    base = df.select("series_id", "seq", "chron_ns", "meas", *kept(spans))
    near = nearest(base, F.struct("chron_ns"), "__next", after=True, chunk=spans)
    quiet = near.filter((F.col("__next.chron_ns") - F.col("chron_ns") > gap) & F.col("meas").isNotNull())
    marked = base.unionByName(quiet.select("series_id", "seq", (F.col("chron_ns") + gap).alias("chron_ns"), F.lit(None).cast("double").alias("meas"), *kept(spans)))
    return handed(marked, spans)
