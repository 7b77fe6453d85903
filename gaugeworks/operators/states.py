"""Mergeable summaries: what has to be known of a span of readings so that the thirty statistics of a series follow from its spans.

A state holds counts, centred moments, extremes with their instants, and the first and last reading, so that the step from one
span to the next isn't lost. Of each of the four quantities that have a median it holds marks: values at known ranks, all of
them if they are few. States of adjacent stretches of time are merged in order; which of them are merged first makes no difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import nav
from gaugeworks.operators.neighbours import deltas
from gaugeworks.operators.runs import arrow_of, groups, passed_on, per_group, sorted_groups
from gaugeworks.operators.spans import AUTO, SPAN, Every, assigned, resolved

#: Marks of a quantity in one state. A median of several states lies between marks that have about 1 / MARKS of the readings between them.
MARKS = 1_024
#: Marks of a quantity that one task passes on for all its states of a series together, and how many it holds before it thins them.
TOGETHER, HELD = 4_096, 65_536
#: States that a task passes on at once.
PASSED_STATES = 128
#: Quantities with a median; the first two are whole nanoseconds.
MEDIANS = ("chron", "dchron", "meas", "dmeas")
_MOMENTS = "{0}_n long, {0}_mean double, {0}_m2 double, {0}_low {1}, {0}_low_at long, {0}_high {1}, {0}_high_at long"
STATE = ", ".join([
    "series_id string", f"{SPAN} long", "n long", "first_chron long", "first_meas double", "last_chron long", "last_meas double", "offsets decimal(38,0)", "n_missing long", "n_broken long",
    "use_chron long", "use_meas double", _MOMENTS.format("ms", "double"), _MOMENTS.format("dm", "double"), "dm_broken long", _MOMENTS.format("dc", "long"),
    *(f"{q}_marks array<{'long' if 'chron' in q else 'double'}>, {q}_count long, {q}_middle {'long' if 'chron' in q else 'double'}" for q in MEDIANS),
])
NAMES = [x.split()[0] for x in STATE.replace(", ", ",").replace("decimal(38,0)", "d").split(",")]
#: What ``combined`` adds: the weights of marks that stand for several states, null where a state's own follow from its count.
_WEIGHTS = ", ".join(f"{q}_weights array<long>, {q}_slack long" for q in MEDIANS)
COMBINED = f"{STATE}, {_WEIGHTS}"
#: Where a state's marks begin.
_PLAIN = len(NAMES) - 3 * len(MEDIANS)


@dataclass
class Moments:
    """Of numbers with instants, in order: how many, mean, sum of squares about it, and the earliest extremes."""

    n: int = 0
    mean: float | None = None
    m2: float | None = None
    low: float | None = None
    low_at: int | None = None
    high: float | None = None
    high_at: int | None = None

    @classmethod
    def of(cls, values: np.ndarray, at: np.ndarray) -> Moments:
        if not len(values):
            return cls()
        with np.errstate(all="ignore"):
            numbers = values.astype(float)
            mean = float(numbers.mean())
            m2 = float(((numbers - mean) ** 2).sum())
        low, high = int(values.argmin()), int(values.argmax())
        return cls(len(values), mean, m2, values[low].item(), int(at[low]), values[high].item(), int(at[high]))

    def then(self, b: Moments) -> Moments:
        """Those of both, ``b`` being later."""
        if not self.n or not b.n:
            return self if self.n else b
        n, d = self.n + b.n, b.mean - self.mean
        low, high = (b if b.low < self.low else self), (b if b.high > self.high else self)
        return Moments(n, self.mean + d * (b.n / n), self.m2 + b.m2 + d * d * (self.n * b.n / n), low.low, low.low_at, high.high, high.high_at)

    def std(self) -> float | None:
        return None if self.n < 2 else float(np.sqrt(self.m2 / (self.n - 1)))

    def row(self) -> tuple:
        return self.n, self.mean, self.m2, self.low, self.low_at, self.high, self.high_at


def marks(values: np.ndarray) -> tuple:
    """(all values sorted, or MARKS of them at evenly spread ranks, both ends among them; how many there are; their lower middle)."""
    values, n = np.sort(values), len(values)
    return values if n <= MARKS else values[_places(n, MARKS)], n, values[(n - 1) // 2].item() if n else None


def _places(n: int, kept: int) -> np.ndarray:
    return np.arange(n) if kept >= n else np.arange(kept) * (n - 1) // (kept - 1)


@dataclass
class Marks:
    """Sorted values of readings. At least as many readings as the weights up to a value sum to aren't above it; those below it are at most
    ``slack`` more than the weights of lesser values sum to."""

    values: np.ndarray
    weights: np.ndarray
    slack: int = 0

    @classmethod
    def of(cls, values: np.ndarray, n: int) -> Marks:
        """A state's own, of ``n`` readings."""
        weights = np.diff(_places(n, len(values)), prepend=-1)
        return cls(values, weights, int(weights.max()) - 1)

    @classmethod
    def together(cls, parts: list[Marks]) -> Marks:
        values, weights = (np.concatenate([getattr(p, k) for p in parts]) for k in ("values", "weights"))
        order = np.argsort(values, kind="stable")
        return cls(values[order], weights[order], sum(p.slack for p in parts))

    def thinned(self, kept: int) -> Marks:
        """``kept`` of them at most, both ends among them; what is left out adds its weight to the next one above."""
        if len(self.values) <= kept:
            return self
        upto = np.cumsum(self.weights)
        at = np.unique(np.searchsorted(upto, _places(int(upto[-1]), kept) + 1))
        weights = np.diff(upto[at], prepend=0)
        return Marks(self.values[at], weights, self.slack + int((weights - self.weights[at]).max()))

    def bracket(self, rank: int):
        upto = np.cumsum(self.weights)  # at least so many are not above
        first = np.append(True, self.values[1:] != self.values[:-1])
        below = (upto - self.weights)[first]  # at least so many are below, at most ``slack`` more
        low = self.values[first][max(0, int(np.searchsorted(below, rank - 1 - self.slack, "right")) - 1)]
        return low.item(), self.values[int(np.searchsorted(upto, rank))].item()


def bracket(parts: list[tuple[np.ndarray, int]], rank: int):
    """(low, high) between which the value at ``rank`` (from 1) of all parts together lies, ends included; each part is marks and the number of values."""
    return Marks.together([Marks.of(v, n) for v, n in parts]).bracket(rank)


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(instants, measurements with 0 for the missing ones, which are missing)."""
    meas = table.column("meas").combine_chunks()
    return table.column("chron_ns").to_numpy(), meas.fill_null(0.0).to_numpy(zero_copy_only=False), meas.is_null().to_numpy(zero_copy_only=False)


def state_of(key: tuple, table: pa.Table) -> Iterator[tuple]:
    chron, meas, missing = _columns(table)
    broken = np.isnan(meas)
    use = ~missing & ~broken
    with np.errstate(all="ignore"):
        step = meas[1:] - meas[:-1]
    torn = broken[1:] | broken[:-1]
    gone = (missing[1:] | missing[:-1]) & ~torn
    torn |= ~gone & np.isnan(step)
    steps = step[~torn & ~gone]
    waits = np.diff(chron)
    one = lambda i: (int(chron[i]), None if missing[i] else float(meas[i]))
    first_use = int(use.argmax()) if use.any() else None
    numbers = {"chron": chron, "dchron": waits, "meas": meas[use], "dmeas": steps}
    yield (
        *key, len(chron), *one(0), *one(-1), _whole_sum(chron - chron[0]), int(missing.sum()), int(broken.sum()), *((None, None) if first_use is None else one(first_use)),
        *Moments.of(meas[use], chron[use]).row(), *Moments.of(steps, chron[1:][~torn & ~gone]).row(), int(torn.sum()), *Moments.of(waits, chron[1:]).row(),
        *(x for q in MEDIANS for x in marks(numbers[q])),
    )


def _whole_sum(offsets: np.ndarray):
    """Exact, whatever the size."""
    from decimal import Decimal

    high, low = offsets >> 31, offsets & (2**31 - 1)
    return Decimal((int(high.sum()) << 31) + int(low.sum()))


def states(df: DataFrame, chunk=AUTO) -> DataFrame:
    """STATE of every series, or of every span of one that is cut: one exchange and one scan. Keep it, and union to it that of readings that
    came later than all of a series'."""
    arrow = arrow_of(STATE)
    return _spans(df, chunk).mapInArrow(lambda batches: passed_on(_each(batches), arrow, PASSED_STATES), STATE)


def brief(df: DataFrame, chunk=AUTO) -> DataFrame:
    """``combined`` of ``states``, made by the tasks that scan the readings: marks of single states never leave them."""
    arrow = arrow_of(COMBINED)
    return _spans(df, chunk).mapInArrow(lambda batches: passed_on(_combined(_each(batches)), arrow, PASSED_STATES), COMBINED)


def combined(kept: DataFrame) -> DataFrame:
    """``kept`` with the marks of states of one series that stand together in a partition taken together and thinned, beside the last of
    them: what one task then merges grows with the tasks, not with the states."""
    arrow = arrow_of(COMBINED)
    return kept.select(*NAMES).mapInArrow(lambda batches: passed_on(_combined(tuple(r.values()) for b in batches for r in _rows(b)), arrow, PASSED_STATES), COMBINED)


def _spans(df: DataFrame, chunk) -> DataFrame:
    return sorted_groups(assigned(df, resolved(df, chunk)), ["series_id", SPAN], ["chron_ns", "seq"], ["meas"])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for key, table in groups(batches, 2):
        yield from state_of(key, table)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dicts, arrays as views of the batch."""
    arrays = [f.name for f in batch.schema if pa.types.is_list(f.type) or pa.types.is_large_list(f.type)]
    views = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy(zero_copy_only=False)) for c in arrays}
    plain = batch.select([c for c in batch.schema.names if c not in views]).to_pylist()
    for i, row in enumerate(plain):
        yield {c: views[c][1][views[c][0][i] : views[c][0][i + 1]] if c in views else row[c] for c in batch.schema.names}


def _combined(rows: Iterator[tuple]) -> Iterator[tuple]:
    for _, run in groupby(rows, lambda row: row[0]):
        last, several, held, size = None, False, {q: [] for q in MEDIANS}, dict.fromkeys(MEDIANS, 0)
        for row in run:
            if last is not None:
                several = True
                yield (*last[:_PLAIN], *(None, 0, None) * len(MEDIANS), *(None, None) * len(MEDIANS))
            last = row
            for i, (q, parts) in enumerate(held.items()):
                values, n = row[_PLAIN + 3 * i : _PLAIN + 3 * i + 2]
                if n:
                    parts.append(Marks.of(np.asarray(values), n))
                    size[q] += len(values)
                if size[q] > HELD:
                    parts[:] = [Marks.together(parts).thinned(HELD // 2)]
                    size[q] = len(parts[0].values)
        if not several:
            yield (*last, *(None, None) * len(MEDIANS))
            continue
        told = [Marks.together(parts).thinned(TOGETHER) if parts else None for parts in held.values()]
        own = (x for m in told for x in ((m.values, int(m.weights.sum()), None) if m else (None, 0, None)))
        yield (*last[:_PLAIN], *own, *(x for m in told for x in ((m.weights, m.slack) if m else (None, None))))


class Merged:
    """All of a series' states, taken in order of time."""

    def __init__(self, row: dict):
        self.n, self.first, self.last, self.offsets = row["n"], (row["first_chron"], row["first_meas"]), (row["last_chron"], row["last_meas"]), int(row["offsets"])
        self.missing, self.broken, self.use, self.torn = row["n_missing"], row["n_broken"], (row["use_chron"], row["use_meas"]), row["dm_broken"]
        self.ms, self.dm, self.dc = (Moments(*(row[f"{k}_{f}"] for f in ("n", "mean", "m2", "low", "low_at", "high", "high_at"))) for k in ("ms", "dm", "dc"))
        self.marks = {q: [self._marks(row, q)] if row[f"{q}_count"] else [] for q in MEDIANS}
        self.middles = {q: row[f"{q}_middle"] for q in MEDIANS}  # of one state these are the medians
        self.seams = {"dchron": [], "dmeas": []}  # steps from one state to the next

    @staticmethod
    def _marks(row: dict, q: str) -> Marks:
        values, slack = np.asarray(row[f"{q}_marks"]), row.get(f"{q}_slack")
        return Marks.of(values, row[f"{q}_count"]) if slack is None else Marks(values, np.asarray(row[f"{q}_weights"]), slack)

    def then(self, b: Merged) -> None:
        """Takes in ``b``, whose readings come after all of these."""
        if b.first[0] < self.last[0]:
            raise ValueError("states of one series overlap in time")
        self.middles = {}
        at, wait = b.first[0], b.first[0] - self.last[0]
        seam = Merged._seam(self.last[1], b.first[1])
        self.offsets += b.offsets + b.n * (b.first[0] - self.first[0])
        self.dc = self.dc.then(Moments(1, float(wait), 0.0, wait, at, wait, at)).then(b.dc)
        self.marks["dchron"].append(Marks(np.array([wait]), np.array([1])))
        self.seams["dchron"].append(wait)
        if seam is not None and seam == seam:
            self.dm = self.dm.then(Moments(1, seam, 0.0, seam, at, seam, at))
            self.marks["dmeas"].append(Marks(np.array([seam]), np.array([1])))
            self.seams["dmeas"].append(seam)
        self.dm, self.ms = self.dm.then(b.dm), self.ms.then(b.ms)
        self.torn += b.torn + (seam is not None and seam != seam)
        self.n, self.missing, self.broken, self.last = self.n + b.n, self.missing + b.missing, self.broken + b.broken, b.last
        self.use = self.use if self.use[0] is not None else b.use
        for q in MEDIANS:
            self.marks[q] += b.marks[q]

    @staticmethod
    def _seam(a: float | None, b: float | None) -> float | None:
        if any(x is not None and x != x for x in (a, b)):
            return float("nan")
        return None if a is None or b is None else b - a

    def medians(self) -> dict[str, tuple]:
        """Of each quantity that has values: its lower middle's rank and the bracket it lies in."""
        out = {}
        for q in MEDIANS:
            total = sum(int(m.weights.sum()) for m in self.marks[q])
            if total and self.middles:
                out[q] = ((total + 1) // 2, self.middles[q], self.middles[q])
            elif total:
                out[q] = ((total + 1) // 2, *Marks.together(self.marks[q]).bracket((total + 1) // 2))
        return out

    def row(self, key: str | None) -> tuple:
        told = self.medians()
        settled = {q: x[1] for q, x in told.items() if x[1] == x[2]}
        open_ = [(q, x[0], *((*x[1:], None, None) if "chron" in q else (None, None, *x[1:])), *((self.seams.get(q), None) if "chron" in q else (None, self.seams.get(q)))) for q, x in told.items() if x[1] != x[2]]
        nan = float("nan")
        number = lambda x, torn: nan if torn else x
        ms, dm, dc = self.ms, self.dm, self.dc
        sound = lambda x: None if self.broken else x
        return (
            key, self.n, *self.first, *self.last, settled.get("chron"), self.first[0] + self.offsets // self.n, *self.use,
            number(ms.low, self.broken), sound(ms.low_at), number(ms.high, self.broken), sound(ms.high_at), number(ms.mean, self.broken), number(settled.get("meas"), self.broken), number(ms.std(), self.broken),
            dc.low, dc.low_at, dc.high, dc.high_at, (self.last[0] - self.first[0]) / dc.n if dc.n else None, None if "dchron" not in settled else float(settled["dchron"]), dc.std(),
            number(dm.low, self.torn), number(dm.high, self.torn), number(settled.get("dmeas"), self.torn), number(dm.mean, self.torn), number(dm.std(), self.torn), self.missing + self.broken, self.missing, open_,
        )


def _merge(key: tuple, table: pa.Table) -> Iterator[tuple]:
    merged = None
    for row in (r for b in table.to_batches() for r in _rows(b)):
        if merged is None:
            merged = Merged(row)
        else:
            merged.then(Merged(row))
    yield merged.row(*key)


_OPEN = "which string, rank long, low_l long, high_l long, low_d double, high_d double, seams_l array<long>, seams_d array<double>"
SUMMARY = (
    "series_id string, len long, chmin long, val_at_chmin double, chmax long, val_at_chmax double, chmed long, chmean long, ch_first_usable long, val_at_first_usable double, "
    "msmin double, ch_at_msmin long, msmax double, ch_at_msmax long, msmean double, msmed double, msstd double, dchmin long, ch_at_dchmin long, dchmax long, ch_at_dchmax long, dchmean double, dchmed double, dchstd double, "
    "dmsmin double, dmsmax double, dmsmed double, dmsmean double, dmsstd double, nbre_of_nan long, nbre_of_nav long"
)
_FIELD = {"chron": "chmed", "dchron": "dchmed", "meas": "msmed", "dmeas": "dmsmed"}


def merged(kept: DataFrame) -> DataFrame:
    """SUMMARY of every series from its states, combined or not, and __open: brackets of the medians that the states don't settle, which are missing. States of one
    series must not overlap in time, but for readings of one instant that a span index has parted."""
    opened = ", ".join(f"{a}:{b}" for a, b in (x.split() for x in _OPEN.split(", ")))
    order = ["first_chron", "last_chron", SPAN]
    return per_group(kept, ["series_id"], order, [c for c in kept.columns if c != "series_id"], _merge, f"{SUMMARY}, __open array<struct<{opened}>>")


def settled(told: DataFrame, readings: DataFrame, chunk=AUTO, same: bool = False) -> DataFrame:
    """``merged``'s rows with the open medians found among ``readings``: those below a bracket are counted, those in it counted by value.

    same: the states are those of ``readings`` cut by ``chunk``. Their exchange then serves again, and steps between spans are known from the merge.
    """
    spans = resolved(readings, chunk)
    small = F.broadcast if same and not isinstance(spans, Every) else lambda df: df  # one series of each SPAN_ROWS readings at most is cut
    open_ = told.select(F.col("series_id").alias("__id"), F.inline("__open"))  # at most four rows for each series of several states
    asked = small(open_.drop("seams_l", "seams_d"))
    lacking = small(open_.select(F.col("__id").alias("__lacking")).distinct())
    wanted = lambda df: df.join(lacking, F.col("series_id").eqNullSafe(F.col("__lacking")), "left_semi")
    if same:
        before = F.lag(F.struct("chron_ns", "meas")).over(Window.partitionBy("series_id", SPAN).orderBy("chron_ns", "seq"))
        rows = wanted(_spans(readings, spans)).withColumn("__before", before)
        step = F.when(F.col("__before").isNotNull(), nav.sub("meas", F.col("__before.meas")))
        rows = rows.select("series_id", "chron_ns", "meas", (F.col("chron_ns") - F.col("__before.chron_ns")).alias("dchron_ns"), step.alias("dmeas"))
    else:
        rows = deltas(wanted(readings), spans)
    none_l, none_d = F.lit(None).cast("long"), F.lit(None).cast("double")
    of = lambda q, c: F.struct(F.lit(q).alias("which_"), F.col(c).alias("l") if "chron" in q else none_l.alias("l"), none_d.alias("d") if "chron" in q else F.when(nav.usable(c), F.col(c)).alias("d"))
    each = rows.select("series_id", F.inline(F.array(*(of(q, c) for q, c in zip(MEDIANS, ("chron_ns", "dchron_ns", "meas", "dmeas"))))))
    if same:
        seam = lambda c, l, d: open_.select(F.col("__id").alias("series_id"), F.col("which").alias("which_"), F.explode(c).alias("__v")).select("series_id", "which_", l.alias("l"), d.alias("d"))  # noqa: E731, E741
        each = each.unionByName(seam("seams_l", F.col("__v"), none_d)).unionByName(seam("seams_d", none_l, F.col("__v")))
    each = each.filter("l is not null or d is not null")
    met = each.join(asked, F.col("series_id").eqNullSafe(F.col("__id")) & (F.col("which") == F.col("which_"))).filter("l <= high_l or d <= high_d")
    inside = F.coalesce(F.col("l") >= F.col("low_l"), F.col("d") >= F.col("low_d"))
    counts = met.select("series_id", "which", "rank", F.when(inside, F.col("l")).alias("l"), F.when(inside, F.col("d")).alias("d")).groupBy("series_id", "which", "rank", "l", "d").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("series_id", "which").orderBy(F.asc_nulls_first("l"), F.asc_nulls_first("d")))
    found = counts.withColumn("upto", upto).filter("(l is not null or d is not null) and upto >= rank")
    first = found.groupBy("series_id").agg(*(F.min(F.when(F.col("which") == q, F.col("l" if "chron" in q else "d"))).alias(f"__{q}") for q in MEDIANS)).withColumnRenamed("series_id", "__id")
    met = told.drop("__open").join(first, F.col("series_id").eqNullSafe(F.col("__id")), "left")
    return met.withColumns({f: F.coalesce(f, F.col(f"__{q}").cast("long" if q == "chron" else "double")) for q, f in _FIELD.items()}).select(*told.drop("__open").columns)
