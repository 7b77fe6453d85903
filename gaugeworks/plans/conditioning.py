"""Whole plans: from raw readings to a filled grid, and from raw readings to transitions and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators import cleaning, compress, fill, resample
from gaugeworks.operators.spans import AUTO, resolved


def conditioned(df: DataFrame, low: float = 1, high: float = 200, step="1h", agg="mean", how="linear", max_gap="2h", chunk=AUTO) -> DataFrame:
    """Out-of-bounds readings removed, an even grid, short gaps filled."""
    chunk = resolved(df, chunk)
    cleaned, _ = cleaning.remove_outbounds(df, low, high)
    grid = resample.regularize(cleaned, step, agg, chunk=chunk)
    return fill.interpolate(grid.withColumn("seq", F.lit(0).cast("long")), how, max_gap, chunk).drop("seq")


def restored(df: DataFrame, max_gap, start_ns: int, end_ns: int, step, chunk=AUTO) -> DataFrame:
    """Silences marked, transitions kept, and the signal held on a grid again."""
    chunk = resolved(df, chunk)
    return compress.expand(compress.reduce(compress.mark_silences(df, max_gap, chunk), chunk), start_ns, end_ns, step, chunk)
