"""Series, statistics and containers as JSON: what is no finite number is null."""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.neighbours import AUTO, deltas
from gaugeworks.operators.stats import stats
from gaugeworks.sources.readings import PART_ROWS, parts

#: The keys of a summary, each with the field that it shows.
STATS_KEYS = {
    "len": "len", "chmin": "chmin", "valAtChmin": "val_at_chmin", "chmax": "chmax", "valAtChmax": "val_at_chmax",
    "chmed": "chmed", "chmean": "chmean", "chFirstUsable": "ch_first_usable", "valAtFirstUsable": "val_at_first_usable",
    "msmin": "msmin", "chAtMsmin": "ch_at_msmin", "msmax": "msmax", "chAtMsmax": "ch_at_msmax", "msmean": "msmean", "msmed": "msmed", "msstd": "msstd",
    "dChmin_ns": "dchmin", "chAtDChmin": "ch_at_dchmin", "dChmax_ns": "dchmax", "chAtDChmax": "ch_at_dchmax", "dChmean_ns": "dchmean", "dChmed_ns": "dchmed", "dChstd_ns": "dchstd",
    "dMsmin": "dmsmin", "dMsmax": "dmsmax", "dMsmed": "dmsmed", "dMsmean": "dmsmean", "dMsstd": "dmsstd", "nbreOfNaN": "nbre_of_nan", "nbreOfNaV": "nbre_of_nav",
}
INSTANTS = {"chmin", "chmax", "chmed", "chmean", "ch_first_usable", "ch_at_msmin", "ch_at_msmax", "ch_at_dchmin", "ch_at_dchmax"}
#: Fixed value: an instant that isn't known.
NO_INSTANT = "0001-01-01T00:00:00Z"


def finite(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def nanos(x: Column | str) -> Column:
    """Whole nanoseconds, halves away from zero."""
    return F.round(finite(x)).cast("long")


def rfc3339(at: int | None, tz: str = "UTC") -> str:
    if at is None:
        return NO_INSTANT
    whole, part = divmod(at, 10**9)
    local = (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=whole)).astimezone(ZoneInfo(tz))
    digits = f".{part:09d}".rstrip("0") if part else ""
    offset = local.strftime("%z")
    return local.strftime("%Y-%m-%dT%H:%M:%S").rjust(19, "0") + digits + ("Z" if offset == "+0000" else f"{offset[:3]}:{offset[3:]}")


def rfc3339_text(at: Column | str) -> Column:
    """The same for a column, in UTC, at full precision."""
    at = F.col(at) if isinstance(at, str) else at
    second, part = F.call_function("div", at - F.pmod(at, F.lit(10**9)), F.lit(10**9)), F.pmod(at, F.lit(10**9))
    digits = F.regexp_replace(F.concat(F.lit("."), F.lpad(part.cast("string"), 9, "0")), r"\.?0+$", "")
    text = F.concat(F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss"), F.when(part == 0, "").otherwise(digits), F.lit("Z"))
    return F.coalesce(text, F.lit(NO_INSTANT))


def columns(df: DataFrame, rows: int = PART_ROWS, chunk=AUTO) -> DataFrame:
    """series_id, part, and arrays chron_ns, meas, dchron_ns, dmeas in order: a series becomes rows of at most ``rows`` readings."""
    return parts(deltas(df, chunk), {"chron_ns": F.col("chron_ns"), "meas": finite("meas"), "dchron_ns": F.col("dchron_ns"), "dmeas": finite("dmeas")}, rows, chunk)


def stats_json(df: DataFrame) -> DataFrame:
    """series_id and json: the thirty statistics as text; instants as nanoseconds. One aggregation for all series."""
    shown = {k: nanos(f) if k.endswith("_ns") and f not in ("dchmin", "dchmax") else finite(f) if f.startswith(("ms", "val", "dms")) else F.col(f) for k, f in STATS_KEYS.items()}
    return stats(df).select("series_id", F.to_json(F.struct(*(c.alias(k) for k, c in shown.items())), {"ignoreNullFields": "false"}).alias("json"))


def _stats_dict(text: str, tz: str) -> dict:
    got = json.loads(text)
    return {k: rfc3339(v, tz) if STATS_KEYS[k] in INSTANTS else v for k, v in got.items()}


def series_dicts(df: DataFrame, name: str = "", comment: str = "", tz: str = "UTC", ids: dict[str, str] | None = None) -> dict[str, dict]:
    """Every series of ``df`` as the dict that a front end reads, brought to the driver part by part: what a browser can show."""
    summaries = {r["series_id"]: r["json"] for r in stats_json(df).collect()}
    out: dict[str, dict] = {}
    for row in columns(df).orderBy("series_id", "part").toLocalIterator():
        told = {"chron": [rfc3339(x, tz) for x in row["chron_ns"]], "meas": row["meas"], "dchron_ns": row["dchron_ns"], "dmeas": row["dmeas"]}
        one = out.get(row["series_id"])
        if one:
            for key, more in told.items():
                one[key] += more
            continue
        one = {"id": (ids or {}).get(row["series_id"], ""), "name": name} | ({"comment": comment} if comment else {})
        out[row["series_id"]] = one | told | {"stats": _stats_dict(summaries[row["series_id"]], tz)}
    return out


def empty_dict(name: str = "", id: str = "") -> dict:
    return {"id": id, "name": name, "chron": [], "meas": []}


def series_dict(series) -> dict:
    """A signal of one series."""
    got = series_dicts(series.df, series.name, series.comment, series.tz if isinstance(series.tz, str) else "UTC")
    if not got:
        return empty_dict(series.name, series.id) | ({"comment": series.comment} if series.comment else {})
    return next(iter(got.values())) | {"id": series.id}


def container_dict(container) -> dict:
    """Series by name; those not produced are left out."""
    held = {k: series_dict(container.series(k)) for k in container.names() if container.series(k) is not None}
    return {"name": container.name} | ({"comment": container.comment} if container.comment else {}) | {"series": held}
