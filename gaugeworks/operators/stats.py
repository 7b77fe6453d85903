"""Thirty statistics of every series, merged from the states of its spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import states as states_
from gaugeworks.operators.spans import AUTO, resolved, whole

#: The fields, in order.
FIELDS = (
    "len", "chmin", "val_at_chmin", "chmax", "val_at_chmax", "chmed", "chmean", "ch_first_usable", "val_at_first_usable",
    "msmin", "ch_at_msmin", "msmax", "ch_at_msmax", "msmean", "msmed", "msstd",
    "dchmin", "ch_at_dchmin", "dchmax", "ch_at_dchmax", "dchmean", "dchmed", "dchstd",
    "dmsmin", "dmsmax", "dmsmed", "dmsmean", "dmsstd", "nbre_of_nan", "nbre_of_nav",
)


def nothing(spark: SparkSession, series: str = "") -> DataFrame:
    """The statistics of a series without readings: none of three kinds, all else missing."""
    kinds = dict(x.split() for x in states_.SUMMARY.split(", "))
    counts = ("len", "nbre_of_nan", "nbre_of_nav")
    return spark.range(1).select(F.lit(series).alias("series_id"), *(F.lit(0 if f in counts else None).cast(kinds[f]).alias(f) for f in FIELDS))


def stats(df: DataFrame, chunk=AUTO) -> DataFrame:
    """series_id and FIELDS. Instants are nanoseconds; means and medians of intervals doubles of nanoseconds.

    Missing readings are stepped over; one broken reading breaks every statistic of the measurements, but not
    the first usable one. Of equal extremes the earliest counts. Medians are lower middles; deviations those of
    a sample. The mean instant is the first plus the mean offset, cut to whole nanoseconds.

    Readings are scanned once. Of a series that is cut the states only bracket the medians; its readings are then scanned once more.
    """
    spans = resolved(df, chunk)
    told = states_.merged(states_.states(df, spans) if whole(spans) else states_.brief(df, spans))
    return (told if whole(spans) else states_.settled(told, df, spans, same=True)).select("series_id", *FIELDS)


def from_states(kept: DataFrame, readings: DataFrame | None = None, chunk=AUTO) -> DataFrame:
    """The same from ``states.states``, also of several batches. Without ``readings`` a median that the states only bracket is missing: none is, where a series' states
    hold at most ``states.MARKS`` readings each; all that a series' states hold is then in one task."""
    told = states_.merged(kept if readings is None else states_.combined(kept))
    return (told.drop("__open") if readings is None else states_.settled(told, readings, chunk)).select("series_id", *FIELDS)
