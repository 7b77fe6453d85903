"""Readings by their rank: how many lie in each span, and before it, tells where a rank is; only that span is read and sorted."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from gaugeworks.functions import nav
from gaugeworks.operators.spans import AUTO, SPAN, assigned, resolved

#: Readings that a walk brings to the driver at a time, about, where series are shorter than that.
PAGE_ROWS = 100_000


def span_table(df: DataFrame, spans) -> DataFrame:
    """series_id, SPAN, n, low and high (first and last instant), end (the last reading), before (how many readings of the series lie in
    earlier spans) and carry (the reading before the span's first)."""
    key = F.struct("chron_ns", "seq")
    each = assigned(df, spans).groupBy("series_id", SPAN).agg(F.count("*").alias("n"), F.min("chron_ns").alias("low"), F.max("chron_ns").alias("high"), F.max_by(F.struct("chron_ns", "meas"), key).alias("end"))
    order = Window.partitionBy("series_id").orderBy(SPAN)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.select("*", before.alias("before"), F.lag("end").over(order).alias("carry"))


@dataclass
class Ranks:
    """A look-up of ranks in ``df``. It costs one pass over the instants, made once; then each question reads the spans that answer it.

    Instants are filtered by their range, which a source that keeps them in order skips the rest by.
    """

    df: DataFrame
    spans: object
    table: DataFrame

    @classmethod
    def of(cls, df: DataFrame, chunk=AUTO) -> Ranks:
        from gaugeworks.storage import stored

        spans = resolved(df, chunk)
        return cls(df, spans, stored(span_table(df, spans), "span-ranks"))

    def _read(self, where: Column, met: DataFrame, order: bool = False) -> DataFrame:
        """Readings where ``where`` holds, with deltas and their place; met: the rows of ``table`` that they belong to."""
        cut = assigned(self.df.filter(where), self.spans)
        told = met.select(F.col("series_id").alias("__id"), F.col(SPAN).alias("__at"), "before", "carry")
        rows = cut.join(F.broadcast(told), F.col("series_id").eqNullSafe(F.col("__id")) & F.col(SPAN).eqNullSafe(F.col("__at")))
        own = Window.partitionBy("series_id", SPAN).orderBy("chron_ns", "seq")
        last = F.coalesce(F.lag(F.struct("chron_ns", "meas")).over(own), F.col("carry"))
        rows = rows.withColumn("__last", last).withColumn("place", F.col("before") + F.row_number().over(own) - 1)
        rows = rows.withColumn("dchron_ns", F.col("chron_ns") - F.col("__last.chron_ns")).withColumn("dmeas", F.when(F.col("__last").isNotNull(), nav.sub("meas", F.col("__last.meas"))))
        return rows.select(*self.df.columns, "dchron_ns", "dmeas", "place")

    def between(self, low: int, high: int) -> DataFrame:
        """Of every series the readings with places from ``low`` to below ``high``, with deltas and place, unordered."""
        met = self.table.filter((F.col("before") < high) & (F.col("before") + F.col("n") > low))
        bounds = met.agg(F.min("low"), F.max("high"), F.min("series_id"), F.max("series_id")).first()
        if bounds[0] is None:
            return self._read(F.lit(False), met)
        return self._read(_within(*bounds), met).filter(F.col("place").between(low, high - 1))

    def at(self, i: int) -> DataFrame:
        """The i-th reading, from 0, of every series that has it."""
        return self.between(i, i + 1)

    def pages(self, rows: int = PAGE_ROWS) -> Iterator[DataFrame]:
        """All readings by series and order, in frames of a span or of several short series, each ordered by series_id and place."""
        held: list[Row] = []
        for row in self.table.orderBy("series_id", SPAN).toLocalIterator():
            if held and sum(x["n"] for x in held) + row["n"] > rows:
                yield self._page(held)
                held = []
            held.append(row)
        if held:
            yield self._page(held)

    def _page(self, held: list[Row]) -> DataFrame:
        met = self.df.sparkSession.createDataFrame(held, self.table.schema)
        ids = [x["series_id"] for x in held]
        where = _within(min(x["low"] for x in held), max(x["high"] for x in held), None if None in ids else min(ids), None if None in ids else max(ids))
        return self._read(where, met).orderBy("series_id", "place")


def _within(low: int, high: int, first: str | None, last: str | None) -> Column:
    here = F.col("chron_ns").between(low, high)
    if first is None:
        return here
    return here & (F.col("series_id") == first if first == last else F.col("series_id").between(first, last))
