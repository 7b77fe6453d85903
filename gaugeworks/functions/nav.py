"""Missing and broken measurements as columns.

Nothing was measured: NULL, stepped over. A computation broke: NaN, which wins over everything.
Spark sorts NaN above all numbers and takes NaN = NaN as true, so every test looks for it first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x).cast("double")


def is_missing(x: Column | str) -> Column:
    return _col(x).isNull()


def is_broken(x: Column | str) -> Column:
    """False for a missing value."""
    return F.coalesce(F.isnan(_col(x)), F.lit(False))


def usable(x: Column | str) -> Column:
    return _col(x).isNotNull() & ~F.isnan(_col(x))


def _both(a, b, f: Callable[[Column, Column], Column]) -> Column:
    a, b = _col(a), _col(b)
    return F.when(is_broken(a) | is_broken(b), NAN).otherwise(f(a, b))


def add(a, b) -> Column:
    """A missing value is neutral; two are missing."""
    return _both(a, b, lambda a, b: F.coalesce(a + b, a, b))


def sub(a, b) -> Column:
    """Needs both."""
    return _both(a, b, lambda a, b: a - b)


def mul(a, b) -> Column:
    return _both(a, b, lambda a, b: a * b)


def div(a, b) -> Column:
    """Needs both; by zero as IEEE has it: infinite, or NaN for 0/0."""
    zero = lambda a: F.when(a == 0, NAN).when(a > 0, float("inf")).otherwise(float("-inf"))
    return _both(a, b, lambda a, b: F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, zero(a)).otherwise(F.try_divide(a, b)))


def coalesce(*xs) -> Column:
    """The first that isn't missing; a broken one is taken."""
    return F.coalesce(*map(_col, xs))


# Aggregates: missing values are stepped over, a broken one breaks the result.


def _guard(x, agg: Column) -> Column:
    return F.when(F.bool_or(is_broken(x)), NAN).otherwise(agg)


def mean(x) -> Column:
    return F.avg(_col(x))


def total(x) -> Column:
    return F.sum(_col(x))


def least(x) -> Column:
    return _guard(x, F.min(_col(x)))


def greatest(x) -> Column:
    return F.max(_col(x))


def median(x) -> Column:
    """The lower of the two middles."""
    return percentile(x, 50)


def percentile(x, p: float) -> Column:
    """Nearest rank, 0 < p <= 100. Keeps a count for each value of the group: for windows and series of moderate size."""
    if not 0 < p <= 100:
        raise ValueError("0 < p <= 100")
    return _guard(x, F.expr(f"percentile_disc({p / 100!r}) within group (order by {_name(x)})"))


def _name(x) -> str:
    if not isinstance(x, str):
        raise TypeError("percentile and median take a column's name")
    return f"case when not isnan(`{x}`) then `{x}` end"


def std(x) -> Column:
    """Of a sample; fewer than two readings have none."""
    return _guard(x, F.stddev_samp(_col(x)))


def count_usable(x) -> Column:
    return F.count_if(usable(x))


def count_missing(x) -> Column:
    return F.count_if(is_missing(x))


def count_broken(x) -> Column:
    return F.count_if(is_broken(x))


def count_not_missing(x) -> Column:
    return F.count(_col(x))


def shown(x: float | None) -> str:
    """NaV, NaN, or the shortest decimal."""
    if x is None:
        return "NaV"
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "+Inf" if x > 0 else "-Inf"
    return str(int(x)) if x == int(x) and abs(x) < 1e21 else repr(x)
