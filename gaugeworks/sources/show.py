"""Signals, statistics and containers as text, on the driver."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from gaugeworks.durations import written
from gaugeworks.functions.nav import shown

#: What a summary says of each field, by subject: the field, in words, and the instant or value that goes with it.
_SUMMARY = {
    "Values": (("msmin", "smallest", "ch_at_msmin"), ("msmed", "middle", None), ("msmean", "average", None), ("msmax", "greatest", "ch_at_msmax"), ("msstd", "spread", None)),
    "Steps in value": (("dmsmin", "smallest", None), ("dmsmed", "middle", None), ("dmsmean", "average", None), ("dmsmax", "greatest", None), ("dmsstd", "spread", None)),
    "Steps in time": (("dchmin", "smallest", "ch_at_dchmin"), ("dchmed", "middle", None), ("dchmean", "average", None), ("dchmax", "greatest", "ch_at_dchmax"), ("dchstd", "spread", None)),
    "Instants": (("chmin", "from", "val_at_chmin"), ("ch_first_usable", "first number", "val_at_first_usable"), ("chmed", "middle", None), ("chmean", "average", None), ("chmax", "to", "val_at_chmax")),
}


def instant(at: int | None) -> str:
    """2026-01-01 00:00:00.5, or a dash where it isn't known."""
    if at is None:
        return "—"
    t = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=at // 10**9)
    millis = f".{at % 10**9 // 10**6:03d}".rstrip("0").rstrip(".")
    return t.strftime("%Y-%m-%d %H:%M:%S") + millis


def interval(x: float | None) -> str:
    return shown(x) if x is None or x != x else written(int(x))


def _lines(rows: list[list[str]], right: bool = False) -> list[str]:
    widths = [max(map(len, column)) for column in zip(*rows)]
    return [" | ".join(c.rjust(w) if right else c.ljust(w) for c, w in zip(row, widths)).rstrip() for row in rows]


def point_row(p) -> list[str]:
    return [instant(p["chron_ns"]), shown(p["meas"]), written(p["dchron_ns"]), shown(p["dmeas"])]


def series_text(series, *what: int) -> str:
    """All points; the first n; or those from a to below b. Only these are brought to the driver."""
    total = len(series)
    low, high = (0, total) if not what else (0, what[0]) if len(what) == 1 else (what[0], what[1])
    low, high = max(0, low), min(total, high)
    out = [" / ".join(x for x in (series.name, series.id, series.comment) if x)]
    if low >= high:
        return "\n".join([*out, "no points" if total else "no readings"])
    points = series.ranks().between(low, high).orderBy("series_id", "place").collect()
    out += _lines([["#", "instant", "value", "after", "step"], *([str(p["place"]), *point_row(p)] for p in points)], right=True)
    return "\n".join(out + ([f"{high - low} of {total} points"] if high - low < total else []))


def stats_text(s, title: str = "") -> str:
    """s: a row of ``stats``."""
    missing, broken = s["nbre_of_nav"], s["nbre_of_nan"] - s["nbre_of_nav"]
    out = [f"{title}: " * bool(title) + f"{s['len']} readings, of which {missing} NaV and {broken} NaN"]
    if broken:
        out.append("(a NaN makes every figure of the values NaN)")
    text = lambda f: instant(s[f]) if f.startswith("ch") else interval(s[f]) if f.startswith("dch") else shown(s[f])
    for subject, fields in _SUMMARY.items():
        out += [subject, *("  " + line for line in _lines([[words, text(field), "" if beside is None else f"({text(beside)})"] for field, words, beside in fields]))]
    return "\n".join(out)


def whole_text(series, *what: int) -> str:
    """The points, then a summary of each series."""
    return "\n\n".join([series_text(series, *what), *(stats_text(s, s["series_id"] or series.name) for s in series.stats().orderBy("series_id").collect())])


def container_text(container, *what: int, points: bool = True) -> str:
    """Every variant with its points (if wanted) and its summary."""
    out = [" / ".join(x for x in (container.name, container.comment) if x)]
    for name in container.names():
        series = container.series(name)
        shown_ = "nothing was made of it" if series is None else whole_text(series, *what) if points else "\n".join(stats_text(s, name) for s in series.stats().orderBy("series_id").collect())
        out.append(f"== {name}\n{shown_}")
    return "\n\n".join(out if len(out) > 1 else [*out, "no variants"])


def container_stats_text(container) -> str:
    return container_text(container, points=False)
