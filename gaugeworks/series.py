"""Series with a name and a comment, and containers of them: what a user holds in hand."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.durations import ns, written
from gaugeworks.functions import nav
from gaugeworks.operators import cleaning, compress, fill, neighbours, ranks, resample
from gaugeworks.operators import spans as spans_
from gaugeworks.operators import stats as stats_
from gaugeworks.sources import readings as r

#: Comments where a fence can't be built.
NO_PERCENTILES, NO_ZSCORE, NO_PEIRCE = "percentiles on nothing to measure", "z-score on too few readings", "Peirce on too few readings"
#: Fixed values too: the suffixes of names and the wording of comments that the steps below write.
#: Most series whose fences a comment names.
NAMED = 5
UNITS = {"daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}


def new_id() -> str:
    return str(uuid.uuid4())


def _bounds(low: float | None, high: float | None) -> str:
    return f"bounds [{nav.shown(low)}, {nav.shown(high)}]"


@dataclass(frozen=True)
class Signal:
    """Readings of one or many series that are treated alike. Every step returns a new one, lazily."""

    df: DataFrame
    name: str = ""
    id: str = ""
    #: What was done, or a function that finds it out when first asked.
    note: str | Callable[[], str] = ""
    tz: str | DataFrame = "UTC"
    #: How long series are cut; AUTO is found out from the first signal of a chain, and handed on.
    chunk: object = spans_.AUTO

    @property
    def comment(self) -> str:
        return self.note() if callable(self.note) else self.note

    @classmethod
    def new(cls, spark: SparkSession, name: str) -> Signal:
        return cls(r.empty(spark), name)

    def _next(self, df: DataFrame, suffix: str, comment: str | Callable[[], str]) -> Signal:
        if "seq" not in df.columns:
            df = df.withColumn("seq", F.lit(0).cast("long"))
        cut = self.spans
        kept = [spans_.SPAN] if cut == spans_.STORED and spans_.SPAN in df.columns else []
        # A grid no longer has the spans that were stored beside the readings.
        return replace(self, df=df.select(*r.SCHEMA.names, *kept), name=f"{self.name} {suffix}", note=comment, chunk=cut if cut != spans_.STORED or kept else spans_.AUTO)

    @property
    def spans(self):
        """The cuts of this signal's long series. Nothing runs here: they are part of the plan."""
        return spans_.resolved(self.df, self.chunk)

    def indexed(self, rows: int = spans_.SPAN_ROWS) -> Signal:
        """The same, its cuts found now and stored: worth it for a large source of which much is made."""
        return replace(self, chunk=spans_.index(self.df, rows))

    def ranks(self) -> ranks.Ranks:
        """A look-up of readings by their place; it reads all instants once."""
        return ranks.Ranks.of(self.df, self.spans)

    # Ingestion and reading.

    def add(self, chron_ns: int, meas: float | None, series: str | None = None) -> Signal:
        """One point more, after those of its instant; to the signal's one series, if none is named ("s" where there is none yet)."""
        if series is None:
            held = [x["series_id"] for x in self.df.select("series_id").distinct().limit(2).collect()]
            if len(held) > 1:
                raise ValueError("several series: name the one that the point belongs to")
            series = held[0] if held else "s"
        return self.add_batch(r.from_rows(self.df.sparkSession, [(chron_ns, meas)], series))

    def add_batch(self, batch: DataFrame) -> Signal:
        return replace(self, df=r.append(self.df, batch))

    def __len__(self) -> int:
        return self.df.count()

    def at(self, i: int):
        """The i-th point with its deltas; of several series, of each. Only the spans that hold it are sorted."""
        got = self.ranks().at(i).drop("place").collect() if i >= 0 else []
        if not got:
            raise IndexError(i)
        return got[0] if len(got) == 1 else got

    def _end(self, pick):
        key = F.struct("chron_ns", "seq")
        got = [x["p"] for x in self.df.groupBy("series_id").agg(pick(F.struct(*r.SCHEMA.names), key).alias("p")).orderBy("series_id").collect()]
        return None if not got else got[0] if len(got) == 1 else got

    def first(self):
        """The earliest point; of several series, of each; None of nothing."""
        return self._end(F.min_by)

    def last(self):
        return self._end(F.max_by)

    def points(self) -> Iterator:
        """In order, a span at a time: what lies beyond the span where you stop isn't read for it nor sorted."""
        for page in self.ranks().pages():
            yield from page.drop("place").toLocalIterator()

    def range(self, visit: Callable[[int, object], bool]) -> None:
        for i, point in enumerate(self.points()):
            if not visit(i, point):
                return

    def meas(self) -> DataFrame:
        return r.measurements(self.df, chunk=self.spans)

    def deltas(self) -> DataFrame:
        return neighbours.deltas(self.df, self.spans)

    def stats(self) -> DataFrame:
        """A row for each series; one of nothing if there are no readings at all."""
        return stats_.nothing(self.df.sparkSession) if self.df.isEmpty() else stats_.stats(self.df, self.spans)

    # Cleaning: (cleaned, rejected).

    def _split(self, marked: DataFrame, rule: str | Callable[[], str]) -> tuple[Signal, Signal]:
        cleaned, rejected = cleaning.split(marked)
        return self._next(cleaned, "cleaned", rule), self._next(rejected, "rejected", rule)

    def _fences(self, fences: DataFrame, shown: Callable[[object], str], none: str) -> Callable[[], str]:
        """A comment that gives the fence; of several series each one's, up to NAMED of them, after its name."""

        @cache
        def tell() -> str:
            rows = fences.orderBy("series_id").limit(NAMED + 1).collect()
            if len(rows) < 2:
                return shown(rows[0]) if rows else none
            return "; ".join(f"{x['series_id']}: {shown(x)}" for x in rows[:NAMED]) + ("; …" if len(rows) > NAMED else "")

        return tell

    def remove_outbounds(self, low=None, high=None):
        return self._split(cleaning.mark_outbounds(self.df, low, high), _bounds(low, high))

    def remove_percentile_outliers(self, low=None, high=None):
        marked = cleaning.mark_percentile_outliers(self.df, low, high)
        return self._split(marked, self._fences(cleaning.percentile_fences(self.df, low, high), lambda x: _bounds(x["low"], x["high"]), NO_PERCENTILES))

    def remove_zscore_outliers(self, level: float):
        marked = cleaning.mark_zscore_outliers(self.df, level)
        return self._split(marked, self._fences(cleaning.zscore_fences(self.df, level), lambda x: f"z-score at {nav.shown(level)}: [{nav.shown(x['low'])}, {nav.shown(x['high'])}]", NO_ZSCORE))

    def remove_peirce_outliers(self):
        marked = cleaning.mark_peirce_outliers(self.df)
        return self._split(marked, self._fences(cleaning.peirce_limits(self.df), lambda x: f"Peirce criterion: deviation above {nav.shown(x['limit'])}", NO_PEIRCE))

    def remove_stray_points(self, jump: float, direction=cleaning.StrayDirection.BOTH):
        marked = cleaning.mark_stray_points(self.df, jump, direction, chunk=self.spans)
        return self._split(marked, f"stray points, {cleaning.StrayDirection(direction).value}, jump above {nav.shown(jump)}")

    def remove_stray_points_percent(self, percent: float, direction=cleaning.StrayDirection.BOTH):
        marked = cleaning.mark_stray_points(self.df, percent, direction, True, self.spans)
        return self._split(marked, f"stray points, {cleaning.StrayDirection(direction).value}, jump above {nav.shown(percent)}%")

    # Resampling, filling, compressing.

    def regularize(self, step, agg="mean", tolerance=0) -> Signal:
        out = resample.regularize(self.df, step, agg, tolerance, self.spans)
        late = f", late readings tolerated up to {written(ns(tolerance))}" if ns(tolerance) else ""
        return self._next(out, "regularized", f"every {written(ns(step))}{late}")

    def downscale(self, period: str, agg="mean") -> Signal:
        out = resample.downscale(self.df, period, agg, self.tz, self.spans)
        return self._next(out, period, f"grouped by calendar {UNITS[period]}, periods of unequal length")

    def interpolate(self, how, max_gap=0) -> Signal:
        out = fill.interpolate(self.df, how, max_gap, self.spans)
        limit = f", up to {written(ns(max_gap))}" if ns(max_gap) else ""
        return self._next(out, "interpolated", f"gaps filled: {fill.method(how).value}{limit}")

    def reduce(self) -> Signal:
        return self._next(compress.reduce(self.df, self.spans), "reduced", "transitions only")

    def reduce_with_deadband(self, band: float) -> Signal:
        out = compress.reduce_with_deadband(self.df, band, self.spans)
        return self._next(out, "reduced", f"transitions beyond ±{nav.shown(band)}" if band else "transitions only")

    def expand(self, start_ns: int, end_ns: int, step) -> Signal:
        return self._next(compress.expand(self.df, start_ns, end_ns, step, self.spans), "expanded", f"held every {written(ns(step))}")

    def mark_silences(self, max_gap) -> Signal:
        return self._next(compress.mark_silences(self.df, max_gap, self.spans), "watched", f"silences beyond {written(ns(max_gap))} marked as NaV")


class Container:
    """Variants of a signal by name, in order of arrival; a name may hold None: not produced."""

    def __init__(self, name: str = "", comment: str = ""):
        self.name, self.comment = name, comment
        self._held: dict[str, Signal | None] = {}

    def put(self, name: str, series: Signal | None) -> None:
        """A name that is there keeps its place."""
        self._held[name] = series

    def get(self, name: str) -> tuple[Signal | None, bool]:
        return self._held.get(name), name in self._held

    def series(self, name: str) -> Signal | None:
        return self._held.get(name)

    def delete(self, name: str) -> None:
        self._held.pop(name, None)

    def __len__(self) -> int:
        return len(self._held)

    def names(self) -> list[str]:
        return list(self._held)

    def range(self, visit: Callable[[str, Signal | None], bool]) -> None:
        for name, series in list(self._held.items()):
            if not visit(name, series):
                return

    def union(self) -> DataFrame | None:
        """All variants as one frame with variant and variant_rank."""
        frames = [s.df.withColumn("variant", F.lit(k)).withColumn("variant_rank", F.lit(i)) for i, (k, s) in enumerate(self._held.items()) if s is not None]
        out = None
        for f in frames:
            out = f if out is None else out.unionByName(f)
        return out
