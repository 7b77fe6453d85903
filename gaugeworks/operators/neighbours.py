"""The nearest earlier or later row of a series that has something to say, and a row's place in it.

Every operator that looks at neighbours asks here. Long series are cut into spans (``operators.spans``): windows run within a
span, and what earlier or later spans hand on is worked out over one row per span.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.spans import AUTO, SPAN, assigned, handed, joined, only_cut, resolved, turned, whole


@dataclass(frozen=True)
class Look:
    """As column ``name``: ``value``, a struct, of the nearest row before (after) where it isn't null. own: the row itself counts."""

    name: str
    value: Column
    after: bool = False
    own: bool = False


def around(df: DataFrame, looks: list[Look], chunk=AUTO, rank: str | None = None) -> DataFrame:
    """``df`` with a column for each look. rank: a column that settles the order between chron_ns and seq.

    The series meet in one exchange, whatever the number of looks.
    """
    spans, keys = resolved(df, chunk), ["chron_ns", *([rank] if rank else []), "seq"]
    own = [SPAN] if not whole(spans) else []

    def within(look: Look) -> Column:
        frame = Window.partitionBy("series_id", *own).orderBy(*(turned(k, look.after) for k in keys))
        return F.last(look.value, True).over(frame.rowsBetween(Window.unboundedPreceding, 0 if look.own else -1))

    if not own:
        return handed(df.withColumns({x.name: within(x) for x in looks}), spans)
    picks = [(F.min_by if x.after else F.max_by)(x.value, F.when(x.value.isNotNull(), F.struct(*keys))).alias(f"__end{i}") for i, x in enumerate(looks)]
    ends = only_cut(df, spans).groupBy("series_id", SPAN).agg(*picks)
    hand = lambda i, x: F.last(f"__end{i}", True).over(Window.partitionBy("series_id").orderBy(turned(SPAN, x.after)).rowsBetween(Window.unboundedPreceding, -1)).alias(f"__carry{i}")
    carried = ends.select("series_id", SPAN, *(hand(i, x) for i, x in enumerate(looks)))
    near = assigned(df, spans).withColumns({f"__near{i}": within(x) for i, x in enumerate(looks)})
    met = joined(near, carried, spans)
    return handed(met.select(*df.columns, *(F.coalesce(f"__near{i}", f"__carry{i}").alias(x.name) for i, x in enumerate(looks))), spans)


def nearest(df: DataFrame, value: Column, name: str, after: bool = False, own: bool = False, chunk=AUTO, rank: str | None = None) -> DataFrame:
    """One look of ``around``."""
    return around(df, [Look(name, value, after, own)], chunk, rank)


def ranked(df: DataFrame, chunk=AUTO, name: str = "place", of: Column | None = None) -> DataFrame:
    """``df`` with each row's place in its series, from 0: how many rows, or those where ``of`` isn't null, come before."""
    spans, of = resolved(df, chunk), F.lit(1) if of is None else of
    if whole(spans):
        return df.withColumn(name, _numbered(of, "series_id"))
    before = F.sum("__n").over(Window.partitionBy("series_id").orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1))
    sizes = only_cut(df, spans).groupBy("series_id", SPAN).agg(F.count(of).alias("__n")).select("series_id", SPAN, F.coalesce(before, F.lit(0)).alias("__before"))
    met = joined(assigned(df, spans).withColumn("__i", _numbered(of, "series_id", SPAN)), sizes, spans)
    return met.select(*df.columns, (F.coalesce("__before", F.lit(0)) + F.col("__i")).alias(name))


def _numbered(of: Column, *by: str) -> Column:
    return F.count(of).over(Window.partitionBy(*by).orderBy("chron_ns", "seq").rowsBetween(Window.unboundedPreceding, -1))


def deltas(df: DataFrame, chunk=AUTO) -> DataFrame:
    """Readings with dchron_ns and dmeas: what has changed since the reading before; none for the first."""
    from gaugeworks.functions import nav

    spans = resolved(df, chunk)
    near = nearest(df, F.struct("chron_ns", "meas"), "__before", chunk=spans)
    before = F.col("__before")
    dmeas = F.when(before.isNotNull(), nav.sub("meas", before["meas"]))
    return handed(near.withColumn("dchron_ns", F.col("chron_ns") - before["chron_ns"]).withColumn("dmeas", dmeas).drop("__before"), spans)
