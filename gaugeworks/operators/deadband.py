"""What a dead band keeps of a series, though it depends on all that was kept before, by spans in parallel.

A span is a map: from the reading that is held when it begins to the one that is held when it ends. Whatever was held, after the
last reading before the span it lay within the band around that reading, or is of its class; so the map is defined on a short interval.
There it has few pieces: as soon as a reading leaves the band around several held ones, these are the same from then on, and
where the class changes, or a step is twice the band, all are. First every span's map is made, then maps are composed along the
series, a row for each span, then every span is walked through with what it begins with.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import inf, isinf, nextafter
from struct import pack, unpack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.runs import per_group
from gaugeworks.operators.spans import SPAN, assigned, joined, only_cut, whole

#: Classes of readings. Two of one class differ only if they are numbers.
NUMBER, MISSING, BROKEN = 0, 1, 2


def moved(held: float, value: float, band: float) -> bool:
    return value != held and abs(value - held) > band


def _ordinal(x: float) -> int:
    """Numbers in order as whole numbers in order."""
    bits = unpack("<q", pack("<d", x + 0.0))[0]
    return bits if bits >= 0 else -(bits & 0x7FFF_FFFF_FFFF_FFFF)


def _number(n: int) -> float:
    return unpack("<d", pack("<q", n))[0] if n >= 0 else -unpack("<d", pack("<q", -n))[0]


def _edge(value: float, out: float, band: float) -> float:
    """The number furthest from ``value`` towards ``out`` that isn't left by it."""
    near, far = _ordinal(value), _ordinal(out)
    if not moved(out, value, band):
        return out
    while abs(far - near) > 1:
        middle = (near + far) // 2
        near, far = (near, middle) if moved(_number(middle), value, band) else (middle, far)
    return _number(near)


def within(value: float, band: float) -> tuple[float, float]:
    """The least and greatest number that ``value`` doesn't leave, to the last digit."""
    if isinf(value) or band == inf:
        return (value, value) if band < inf else (-inf, inf)
    out = []
    for sign in (-1, 1):
        edge = value + sign * band
        for _ in range(3):  # rounding moves the edge by a digit or so, but near zero digits are finer than the difference can tell
            beyond = nextafter(edge, sign * inf)
            if moved(edge, value, band):
                edge = nextafter(edge, value)
            elif moved(beyond, value, band):
                break
            else:
                edge = beyond
        else:
            edge = _edge(value, value + sign * 2 * band + sign * abs(value), band)
        out.append(edge)
    return out[0], out[1]


def walked(kinds: list[int], values: list[float], kind: int | None, held: float, band: float) -> tuple[list[bool], int | None, float]:
    """(which are kept, what is held at the end) from what is held at the beginning; kind None: nothing is."""
    kept = []
    for k, v in zip(kinds, values):
        go = k != kind or (k == NUMBER and v != held and abs(v - held) > band)
        if go:
            kind, held = k, v
        kept.append(go)
    return kept, kind, held


#: A map as pieces in order: the greatest number of each, what is held in the end, and whether that is the number itself.
Pieces = list[tuple[float, float, bool]]


def span_map(kinds: list[int], values: list[float], kind: int | None, last: float, band: float) -> Pieces:
    """The map of a span after a reading of this kind and value (None: there was none). Of a span that ends in no number only the class counts."""
    if kind != NUMBER:
        return [(inf, walked(kinds, values, kind, 0.0, band)[2], False)]
    low, high = within(last, band)
    alone: list[tuple[float, float, int]] = []  # numbers that have been left, as intervals, and their group
    parent: list[int] = []
    held: list[float] = []  # the groups' present readings, sorted
    groups: list[int] = []

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    for i, (k, v) in enumerate(zip(kinds, values)):
        free = low <= high
        if k != NUMBER or (not free and len(held) == 1):
            if k == NUMBER:
                return [(inf, walked(kinds[i:], values[i:], NUMBER, held[0], band)[2], False)]
            return [(inf, walked(kinds[i:], values[i:], None, 0.0, band)[2], False)]
        if not ((free and (moved(low, v, band) or moved(high, v, band))) or (held and (moved(held[0], v, band) or moved(held[-1], v, band)))):
            continue
        g = len(parent)
        parent.append(g)
        if free:
            least, most = within(v, band)
            if low < least:
                alone.append((low, min(high, nextafter(least, -inf)), g))
                low = least
            if low <= high and high > most:
                alone.append((max(low, nextafter(most, inf)), high, g))
                high = most
        a, b = 0, len(held)
        while a < b and moved(held[a], v, band):
            parent[root(groups[a])] = g
            a += 1
        while b > a and moved(held[b - 1], v, band):
            parent[root(groups[b - 1])] = g
            b -= 1
        del held[b:], groups[b:], held[:a], groups[:a]
        at = bisect_left(held, v)
        if at < len(held) and held[at] == v:
            parent[g] = root(groups[at])
        else:
            held.insert(at, v)
            groups.insert(at, g)
    now = {root(g): v for g, v in zip(groups, held)}
    pieces = [(a, b, now[root(g)], False) for a, b, g in alone] + ([(low, high, 0.0, True)] if low <= high else [])
    out: Pieces = []
    for _, b, v, same in sorted(pieces):
        if out and out[-1][1:] == (v, same):
            out.pop()
        out.append((b, v, same))
    return [*out[:-1], (inf, *out[-1][1:])]


def applied(pieces: Pieces, held: float) -> float:
    b, v, same = pieces[bisect_left([p[0] for p in pieces], held)]
    return held if same else v


def _read(table: pa.Table) -> tuple[list[int], list[float]]:
    meas = table.column("meas").combine_chunks()
    values = meas.fill_null(0.0).to_numpy(zero_copy_only=False)
    missing = meas.is_null().to_numpy(zero_copy_only=False)
    return np.where(missing, MISSING, np.where(np.isnan(values), BROKEN, NUMBER)).tolist(), values.tolist()


def _kind(x: float | None) -> int:
    return MISSING if x is None else BROKEN if x != x else NUMBER


def deadband(df: DataFrame, band: float, spans) -> DataFrame:
    """The readings of ``df`` that are kept, its first and last of each series among them."""
    cut, names = assigned(df, spans), df.columns
    if whole(spans):
        told = cut.withColumns({"__led": F.lit(False), "__last": F.lit(None).cast("double"), "__final": F.lit(True), "__held": F.lit(None).cast("double")})
    else:
        order = Window.partitionBy("series_id").orderBy(SPAN)
        ends = only_cut(df, spans).groupBy("series_id", SPAN).agg(F.max_by(F.struct("meas"), F.struct("chron_ns", "seq")).alias("__e"))
        edges = ends.select("series_id", SPAN, F.lag("__e").over(order).isNotNull().alias("__led"), F.lag("__e").over(order)["meas"].alias("__last"), F.lead("__e").over(order).isNull().alias("__final"))

        def maps(key: tuple, table: pa.Table) -> Iterator[tuple]:
            led, last = table.column("__led")[0].as_py(), table.column("__last")[0].as_py()
            kinds, values = _read(table)
            pieces = span_map(kinds, values, _kind(last) if led else None, last or 0.0, band)
            yield (*key, led, last, *([p[i] for p in pieces] for i in range(3)))

        mapped = per_group(joined(only_cut(df, spans), edges, spans), ["series_id", SPAN], ["chron_ns", "seq"], ["meas", "__led", "__last"], maps, f"series_id string, {SPAN} long, __led boolean, __last double, upto array<double>, out array<double>, same array<boolean>")

        def composed(key: tuple, table: pa.Table) -> Iterator[tuple]:
            held = 0.0
            for row in table.to_pylist():
                yield row["series_id"], row[SPAN], held if row["__led"] and _kind(row["__last"]) == NUMBER else None
                held = applied(list(zip(row["upto"], row["out"], row["same"])), held)

        entries = per_group(mapped, ["series_id"], [SPAN], ["__led", "__last", "upto", "out", "same"], composed, f"series_id string, {SPAN} long, __held double")
        told = joined(joined(cut, edges, spans), entries, spans)
        told = told.withColumns({"__led": F.coalesce("__led", F.lit(False)), "__final": F.coalesce("__final", F.lit(True))})

    def keep(key: tuple, table: pa.Table) -> pa.Table:
        led, last, held, final = (table.column(c)[0].as_py() for c in ("__led", "__last", "__held", "__final"))
        kinds, values = _read(table)
        kept, _, _ = walked(kinds, values, _kind(last) if led else None, held or 0.0, band)
        if final:
            kept[-1] = True
        return table.select(names).filter(pa.array(kept, pa.bool_()))

    columns = [*df.columns, "__led", "__last", "__held", "__final"]
    return per_group(told, ["series_id", SPAN], ["chron_ns", "seq"], columns, keep, df.schema)
