"""Spans of long series, so that one series is many tasks' work.

A series with more than SPAN_ROWS readings is cut at readings of equal rank; shorter ones stay whole. A cut is a place in the
series' order (chron_ns, seq), so neither a burst nor many readings of one instant fill a span. Any cuts give the same
results; those of a source go on being used for all that is made of it.

``chunk``, wherever an operator takes it: AUTO (cuts are part of the plan and found when it runs), None (never cut), a
duration (spans of equal time), an ``Index``, or STORED (``sources.layout`` has written the span beside each reading).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.durations import ns

AUTO, STORED = "auto", "stored"
#: Readings that one task's window has, about.
SPAN_ROWS = 4_000_000
#: Readings of each span that are looked at to choose the cuts, about; and most spans of one series.
LOOKED, MOST = 64, 16_384
#: Cuts that are looked into beside a reading at once: first every BLOCK-th of its series, then those of the block it lies in.
BLOCK = 128
SPAN = "__span"
#: What is handed from span to span is one row each, at most all readings / SPAN_ROWS and one more for each long series: small enough to broadcast.
_HASHES = 1 << 30


@dataclass(frozen=True)
class Index:
    """cuts: series_id and cuts (sorted array of structs c, s), a row for each long series; None if there is none."""

    cuts: DataFrame | None


@dataclass(frozen=True)
class Every:
    """Spans of so many nanoseconds, of all series."""

    size: int


def cuts(df: DataFrame, rows: int = SPAN_ROWS) -> DataFrame:
    """series_id and cuts for the series of ``df`` that have more than ``rows`` readings, as a plan: no job runs here.

    Of a long series about LOOKED readings a span, told by a hash of their place, are sorted, and every LOOKED-th is a cut.
    """
    n = df.groupBy("series_id").agg(F.count("*").alias("__n")).filter(F.col("__n") > rows)
    n = n.withColumn("__k", F.least(F.ceil(F.col("__n") / rows), F.lit(MOST)))  # at most all readings / rows series
    long = n.select(F.col("series_id").alias("__id"), "__k", F.least(F.lit(1.0), F.col("__k") * LOOKED / F.col("__n")).alias("__rate"))
    met = df.select("series_id", "chron_ns", "seq").join(F.broadcast(long), F.col("series_id").eqNullSafe(F.col("__id")))
    some = met.filter(F.pmod(F.xxhash64("series_id", "chron_ns", "seq"), F.lit(_HASHES)) < F.col("__rate") * _HASHES)
    seen = some.groupBy("series_id").agg(F.sort_array(F.collect_set(F.struct(F.col("chron_ns").alias("c"), F.col("seq").alias("s")))).alias("__seen"), F.first("__k").alias("__k"))
    return seen.select("series_id", F.expr("transform(array_distinct(transform(sequence(1L, greatest(1L, __k - 1)), i -> cast(i * size(__seen) div __k as int))), i -> __seen[i])").alias("cuts"))


def index(df: DataFrame, rows: int = SPAN_ROWS) -> Index:
    """The cuts of ``df``, found now, by two passes over its places, and stored: what a chain of steps is given at its source."""
    from gaugeworks.storage import stored

    if not df.groupBy("series_id").count().filter(F.col("count") > rows).limit(1).count():
        return Index(None)
    return Index(stored(cuts(df, rows), "span-cuts"))


def resolved(df: DataFrame, chunk) -> Index | Every | str:
    """What ``chunk`` means for ``df``, once for all windows of an operator. Runs nothing. AUTO: what ``df`` has been handed, if it was made by an operator."""
    if isinstance(chunk, (Index, Every)) or chunk == STORED:
        return chunk
    if chunk is None:
        return Index(None)
    if chunk != AUTO:
        return Every(ns(chunk))
    return getattr(df, _HANDED, None) or getattr(handed(df, Index(cuts(df, SPAN_ROWS))), _HANDED)


#: The attribute of a frame that says how its series are cut.
_HANDED = "_gaugeworks_spans"


def handed(df: DataFrame, spans) -> DataFrame:
    """``df``, cut for later operators as what it was made of: else each step of a chain would count all that comes before it anew."""
    if spans != STORED or SPAN in df.columns:
        setattr(df, _HANDED, spans)
    return df


def kept(spans) -> list[str]:
    """The column that a stored table's readings must not lose."""
    return [SPAN] if spans == STORED else []


def beyond(df: DataFrame, spans):
    """Cuts for rows that are made of ``df`` and lie elsewhere, such as a grid's."""
    return Index(cuts(df, SPAN_ROWS)) if spans == STORED else spans


def whole(spans) -> bool:
    """Nothing is ever cut."""
    return isinstance(spans, Index) and spans.cuts is None


def _found(array: str, steps: int) -> str:
    """How many of the sorted ``array`` aren't after the reading: a search by halves."""
    at = f"__got + shiftleft(1, {steps - 1} - __step)"
    return f"aggregate(sequence(0, {steps - 1}), 0, (__got, __step) -> if({at} <= size({array}) and {array}[{at} - 1] <= struct(chron_ns as c, seq as s), {at}, __got))"


def _placed(df: DataFrame, spans: Index, how: str) -> DataFrame:
    """``df`` with SPAN. A join copies the cuts that it brings beside each reading, so all cuts of a series would cost each reading as much as there are spans."""
    starts = f"sequence(0, size(cuts) - 1, {BLOCK})"
    rough = spans.cuts.select(F.col("series_id").alias("__id"), F.expr(f"transform({starts}, i -> cuts[i])").alias("__rough"))
    fine = spans.cuts.select(F.col("series_id").alias("__of"), F.posexplode(F.expr(f"transform({starts}, i -> slice(cuts, i + 1, {BLOCK}))")).alias("__at", "__fine"))
    met = df.join(F.broadcast(rough), F.col("series_id").eqNullSafe(F.col("__id")), how)
    met = met.withColumn("__block", F.when(F.col("__rough").isNotNull(), F.expr(_found("__rough", (MOST // BLOCK).bit_length())) - 1)).drop("__rough", "__id")
    met = met.join(F.broadcast(fine), F.col("series_id").eqNullSafe(F.col("__of")) & (F.col("__block") == F.col("__at")), "left")
    inside = F.expr(f"__block * {BLOCK} + {_found('__fine', BLOCK.bit_length())}")
    return met.withColumn(SPAN, F.when(F.col("__block") < 0, 0).otherwise(inside).cast("long")).drop("__block", "__of", "__at", "__fine")


def assigned(df: DataFrame, spans) -> DataFrame:
    """``df`` with SPAN: null in a series that isn't cut."""
    if spans == STORED:
        return df
    if isinstance(spans, Every):
        return df.withColumn(SPAN, F.floor(F.col("chron_ns") / spans.size))
    if spans.cuts is None:
        return df.withColumn(SPAN, F.lit(None).cast("long"))
    return _placed(df, spans, "left")


def joined(cut: DataFrame, per_span: DataFrame, spans) -> DataFrame:
    """``cut`` with what ``per_span`` (series_id, SPAN, ...) says of its span; null where a series isn't cut."""
    told = per_span.withColumnsRenamed({"series_id": "__id", SPAN: "__at"})
    small = told if isinstance(spans, Every) else F.broadcast(told)
    return cut.join(small, F.col("series_id").eqNullSafe(F.col("__id")) & (F.col(SPAN) == F.col("__at")), "left").drop("__id", "__at")


def only_cut(df: DataFrame, spans) -> DataFrame:
    """The readings of series that are cut, with SPAN. Where none is, the plan ends at the empty table of cuts."""
    if isinstance(spans, Index) and spans.cuts is not None:
        return _placed(df, spans, "inner")
    return assigned(df, spans).filter(F.col(SPAN).isNotNull())


def turned(column: str, after: bool) -> Column:
    return F.col(column).desc() if after else F.col(column)
