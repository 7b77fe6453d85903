"""Small series: instants in minutes from 2026-01-01, gaps as None, errors as NaN."""

from gaugeworks.sources.readings import from_rows

ORIGIN = 1767225600 * 10**9
MINUTE = 60 * 10**9
HOUR = 60 * MINUTE
NAN = float("nan")
INF = float("inf")


def minutes(spark, points):
    return from_rows(spark, [(ORIGIN + round(m * MINUTE), v) for m, v in points])


def hourly(spark, *values):
    return minutes(spark, [(60 * i, v) for i, v in enumerate(values)])


def every_minute(spark, *values):
    return minutes(spark, list(enumerate(values)))


def kind(v):
    return "gap" if v is None else "error" if v != v else round(v, 9)


def got(df, unit=MINUTE):
    """[(minute, value)] in order."""
    rows = df.select("chron_ns", "meas", *([c for c in ("seq",) if c in df.columns])).collect()
    rows.sort(key=lambda r: (r["chron_ns"], r["seq"] if "seq" in r else 0))
    return [((r["chron_ns"] - ORIGIN) / unit, kind(r["meas"])) for r in rows]


def want(*points):
    return [(float(m), kind(v)) for m, v in points]


def values(df):
    return [v for _, v in got(df)]
