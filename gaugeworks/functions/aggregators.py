"""What a window of readings is reduced to.

An aggregator is a function from a Frame, the names of a window's columns, to an aggregate
column. Windows without any reading aren't asked: they are missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gaugeworks.durations import ns
from gaugeworks.functions import nav


@dataclass(frozen=True)
class Frame:
    """Names of the columns of a window: the measurement, its instant, its arrival order, its place from 0."""

    meas: str = "meas"
    chron: str = "chron_ns"
    seq: str = "seq"
    place: str = "place"


Aggregator = Callable[[Frame], Column]


def _edge(pick: Callable, only_usable: bool) -> Aggregator:
    def of(f: Frame) -> Column:
        key = F.struct(f.chron, f.seq)
        return pick(f.meas, F.when(nav.usable(f.meas), key) if only_usable else key)

    return of


def _slope(f: Frame) -> Column:
    """Least squares over the place in the window; gaps have a place."""
    use = nav.usable(f.meas)
    x, y = F.when(use, F.col(f.place).cast("double")), F.when(use, F.col(f.meas))
    n, sx, sy, sxx, sxy = F.count_if(use), F.sum(x), F.sum(y), F.sum(x * x), F.sum(x * y)
    return F.when(F.bool_or(nav.is_broken(f.meas)), nav.NAN).when(n >= 2, F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx))


def integral(step: int | str) -> Aggregator:
    """The sum times the step in seconds."""
    seconds = ns(step) / 1e9
    return lambda f: F.sum(f.meas) * F.lit(seconds)


mean: Aggregator = lambda f: nav.mean(f.meas)
median: Aggregator = lambda f: nav.median(f.meas)
least: Aggregator = lambda f: nav.least(f.meas)
greatest: Aggregator = lambda f: nav.greatest(f.meas)
total: Aggregator = lambda f: nav.total(f.meas)
first: Aggregator = _edge(F.min_by, False)
last: Aggregator = _edge(F.max_by, False)
first_usable: Aggregator = _edge(F.min_by, True)
last_usable: Aggregator = _edge(F.max_by, True)
count_usable: Aggregator = lambda f: nav.count_usable(f.meas).cast("double")
slope: Aggregator = _slope


def placed(agg: Aggregator) -> Aggregator:
    """``agg``, which reads the column of each reading's place in its window."""
    agg.needs_place = True
    return agg


placed(slope)


def of_readings(make: Callable[[Column], Column]) -> Aggregator:
    """An aggregator of one's own over a window's readings: ``make`` gets the array of its measurements in order,
    missing ones null, and returns a column. The readings of one window are held together."""

    def of(f: Frame) -> Column:
        points = F.array_sort(F.collect_list(F.struct(F.col(f.chron).alias("c"), F.col(f.seq).alias("s"), F.col(f.meas).alias("m"))))
        return make(F.transform(points, lambda p: p["m"]))

    return of


def of_function(compute: Callable[[list[float | None]], float | None]) -> Aggregator:
    """The same with a plain Python function over the list of measurements, run in Arrow batches of windows."""

    @F.arrow_udf(DoubleType())
    def udf(windows: pa.Array) -> pa.Array:
        return pa.array([compute(w) for w in windows.to_pylist()], pa.float64())

    return of_readings(udf)


#: The names that users write.
_NAMED: dict[str, Aggregator] = {
    "mean": mean, "average": mean, "avg": mean, "median": median, "min": least, "minimum": least, "max": greatest, "maximum": greatest,
    "sum": total, "first": first, "open": first, "last": last, "close": last, "firstusable": first_usable, "lastusable": last_usable,
    "count": count_usable, "countusable": count_usable, "slope": slope,
}


def names() -> list[str]:
    return sorted(_NAMED)


def aggregator(name: str) -> Aggregator:
    """By name, whatever its case and the blanks around it."""
    try:
        return _NAMED[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown aggregator {name!r}; known: {', '.join(names())}") from None


def needs_place(agg: Aggregator) -> bool:
    return getattr(agg, "needs_place", False)
