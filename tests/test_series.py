import json
import random

import pytest
from helpers import HOUR, NAN, ORIGIN, every_minute, got, hourly, kind, values

from gaugeworks.operators import cleaning, compress, fill, neighbours, resample, spans
from gaugeworks.operators.neighbours import deltas
from gaugeworks.operators.stats import stats
from gaugeworks.series import Container, Signal, new_id
from gaugeworks.sources import export, show
from gaugeworks.sources.readings import append, at, empty, from_rows, measurements


def changes(df, chunk=None):
    rows = sorted(deltas(df, chunk).collect(), key=lambda r: (r["chron_ns"], r["seq"]))
    return [(kind(r["meas"]), r["dchron_ns"], kind(r["dmeas"])) for r in rows]


@pytest.mark.parametrize("chunk", [None, "2h"])
def test_deltas(spark, chunk):
    assert changes(hourly(spark, 10, None, 14), chunk) == [(10, None, "gap"), ("gap", HOUR, "gap"), (14, HOUR, "gap")]
    assert changes(hourly(spark, 10, NAN, 14), chunk) == [(10, None, "gap"), ("error", HOUR, "error"), (14, HOUR, "error")]
    assert changes(hourly(spark, NAN, None), chunk)[1][2] == "error" and changes(hourly(spark, NAN), chunk)[0][2] == "gap"
    same = from_rows(spark, [(ORIGIN, 10), (ORIGIN + HOUR, 30), (ORIGIN, 20)])
    assert changes(same, chunk) == [(10, None, "gap"), (20, 0, 10), (30, HOUR, 10)]


def test_batches_in_any_order(spark):
    hour = lambda *h: from_rows(spark, [(ORIGIN + x * HOUR, x) for x in h])
    assert values(append(append(hour(4, 6), hour(8, 7)), hour(1, 3))) == [1, 3, 4, 6, 7, 8]
    r = random.Random(7)
    points = [(ORIGIN + r.randrange(20) * HOUR, float(i)) for i in range(40)]
    whole = from_rows(spark, points)
    assert changes(append(from_rows(spark, points[:15]), from_rows(spark, points[15:]))) == changes(whole)
    assert got(append(whole, empty(spark))) == got(whole)


def test_chunks_change_nothing(spark):
    r = random.Random(5)
    points = [(ORIGIN + r.randrange(300) * HOUR, r.choice([None, NAN, 1.0, 2.5])) for _ in range(80)]
    df = from_rows(spark, points)
    for chunk in ("1h", "7h", "400h"):
        assert changes(df, chunk) == changes(df)


#: Statistics of four readings.
STATS = dict(len=4, msmin=10, msmax=30, msmean=20, msmed=20, msstd=10, dchmin=HOUR, dchmax=2 * HOUR, dchmed=HOUR, dmsmin=-10, dmsmax=-10, dmsmed=-10, dmsstd="gap", nbre_of_nan=1, nbre_of_nav=1)


def test_stats(spark):
    df = from_rows(spark, [(ORIGIN + h * HOUR, v) for h, v in ((0, 10), (1, None), (2, 30), (4, 20))])
    s = Signal(df).stats().first()
    for field, expected in STATS.items():
        assert kind(s[field]) == expected, field
    off = lambda f: (s[f] - ORIGIN) / HOUR
    assert (off("chmean"), off("chmed"), off("ch_at_msmin"), off("ch_at_msmax"), off("ch_at_dchmin"), off("ch_at_dchmax")) == (1.75, 1, 0, 2, 1, 4)
    assert s["dchmean"] == pytest.approx(4 * HOUR / 3)


def test_stats_corners(spark):
    tied = Signal(hourly(spark, 5, 12, 5, 12)).stats().first()
    assert tied["ch_at_msmin"] == ORIGIN and tied["ch_at_msmax"] == ORIGIN + HOUR
    nano = Signal(from_rows(spark, [(ORIGIN + i, 1) for i in (0, 2, 4)])).stats().first()
    assert nano["chmean"] == ORIGIN + 2 and nano["chmed"] == ORIGIN + 2
    broken = Signal(hourly(spark, 10, NAN, 30)).stats().first()
    assert all(kind(broken[f]) == "error" for f in ("msmin", "msmax", "msmean", "msmed", "msstd")) and broken["nbre_of_nan"] == 1 and broken["nbre_of_nav"] == 0
    assert broken["ch_at_msmin"] is None and broken["val_at_first_usable"] == 10
    gaps = Signal(hourly(spark, None, None, None)).stats().first()
    assert gaps["nbre_of_nav"] == 3 and gaps["msmin"] is None and gaps["dchmin"] == HOUR
    one = Signal(hourly(spark, 3)).stats().first()
    assert one["msstd"] is None and one["dchmin"] is None
    none = Signal(empty(spark)).stats().first()
    assert [none[f] for f in ("len", "nbre_of_nan", "nbre_of_nav")] == [0, 0, 0] and all(v is None for k, v in none.asDict().items() if k not in ("series_id", "len", "nbre_of_nan", "nbre_of_nav"))
    assert [(f.name, f.dataType) for f in Signal(empty(spark)).stats().schema] == [(f.name, f.dataType) for f in Signal(hourly(spark, 3)).stats().schema]


@pytest.mark.parametrize("rows", [5, 60])
def test_counted_chunks(spark, monkeypatch, rows):
    """Spans chosen from counted rows change no operator's result."""
    r = random.Random(9)
    points = [(ORIGIN + r.randrange(400) * HOUR // 2, r.choice([None, NAN, *[r.gauss(0, 9) for _ in range(9)]])) for _ in range(200)]
    df = from_rows(spark, points).unionByName(from_rows(spark, points[:7], "other"))
    steps = {
        "deltas": neighbours.deltas, "stats": stats, "reduce": compress.reduce, "ranked": neighbours.ranked, "at": lambda d: at(d, 5), "silences": lambda d: compress.mark_silences(d, "2h"),
        "pchip": lambda d: fill.interpolate(d.dropDuplicates(["series_id", "chron_ns"]), "pchip"), "cubic": lambda d: fill.interpolate(d.dropDuplicates(["series_id", "chron_ns"]), "cubic spline"), "stray": lambda d: cleaning.mark_stray_points(d, 5),
        "expand": lambda d: compress.expand(d, ORIGIN, ORIGIN + 50 * HOUR, "1h"), "grid": lambda d: resample.regularize(d, "5h"), "meas": lambda d: measurements(d, 30), "band": lambda d: compress.reduce_with_deadband(d, 6),
    }
    seen = {}
    df = df.filter("seq % 3 <> 1").cache()
    for uncut in (True, False):
        if not uncut:
            monkeypatch.setattr(spans, "SPAN_ROWS", rows)
            df = df.select("*")  # has been handed no cuts
            assert [x["series_id"] for x in spans.cuts(df, rows).collect()] == ["s"]
        for name, step in steps.items():
            shown = sorted(str([float(f"{v:.9g}") if isinstance(v, float) else v for v in x]) for x in step(df).collect())
            assert seen.setdefault(name, shown) == shown, name


def test_series_keeps_its_story(spark):
    s = Signal(hourly(spark, 1, 900, 2, None, 4), "pressure", "p1")
    cleaned, gone = s.remove_outbounds(0, 100)
    assert (cleaned.name, gone.name, cleaned.comment, cleaned.id) == ("pressure cleaned", "pressure rejected", "bounds [0, 100]", "p1")
    grid = cleaned.regularize("1h", tolerance="5m")
    assert grid.name == "pressure cleaned regularized" and grid.comment == "every 1h0m0s, late readings tolerated up to 5m0s"
    assert grid.interpolate("linear", "2h").comment == "gaps filled: linear, up to 2h0m0s"
    assert s.mark_silences("90m").comment == "silences beyond 1h30m0s marked as NaV" and s.reduce_with_deadband(2).comment == "transitions beyond ±2"
    assert s.remove_percentile_outliers(20, 75)[0].comment == "bounds [1, 4]" and s.remove_percentile_outliers(None, 75)[1].comment == "bounds [NaV, 4]"
    assert s.remove_zscore_outliers(1.4)[0].comment.startswith("z-score at 1.4: [-") and s.remove_peirce_outliers()[0].comment.startswith("Peirce criterion: deviation above ")
    few, none = Signal(hourly(spark, 1)), Signal(hourly(spark, None, NAN))
    assert (few.remove_zscore_outliers(2)[0].comment, few.remove_peirce_outliers()[0].comment) == ("z-score on too few readings", "Peirce on too few readings")
    assert none.remove_percentile_outliers(10, 90)[1].comment == "percentiles on nothing to measure"
    two = Signal(from_rows(spark, [(ORIGIN, 1), (ORIGIN + 1, 9)]).unionByName(from_rows(spark, [(ORIGIN, 5), (ORIGIN + 1, 6)], "t")))
    assert two.remove_percentile_outliers(50, None)[0].comment == "s: bounds [1, NaV]; t: bounds [5, NaV]"
    assert s.at(1)["meas"] == 900 and len(s) == 5 and s.first()["meas"] == 1 and s.last()["meas"] == 4
    with pytest.raises(IndexError):
        s.at(5)
    seen = []
    s.range(lambda i, p: seen.append(i) or i < 2)
    assert seen == [0, 1, 2] and s.add(ORIGIN + HOUR // 2, 7).at(1)["meas"] == 7
    assert len(Signal.new(spark, "x")) == 0 and len({new_id() for _ in range(9)}) == 9


def test_container(spark):
    c = Container("plant", "north")
    c.put("raw", Signal(hourly(spark, 1, None, 3, NAN), "raw"))
    c.put("later", None)
    c.put("raw", Signal(hourly(spark, 1, None), "raw"))
    assert c.names() == ["raw", "later"] and c.get("later") == (None, True) and c.get("none") == (None, False) and len(c) == 2
    assert list(export.container_dict(c)["series"]) == ["raw"] and c.union().count() == 2
    text = show.container_text(c)
    assert "== raw" in text and "nothing was made of it" in text and "no variants" in show.container_text(Container("x"))
    assert "Steps in time" in show.container_stats_text(c) and "| value |" not in show.container_stats_text(c)
    c.delete("raw")
    assert c.names() == ["later"]


def test_json(spark):
    d = export.series_dict(Signal(hourly(spark, 1, None, 3, NAN), "raw"))
    assert d["meas"] == [1, None, 3, None] and d["dchron_ns"][0] is None and d["chron"][1] == "2026-01-01T01:00:00Z"
    assert list(d["stats"]) == list(export.STATS_KEYS) and len(d["stats"]) == 30 and d["stats"]["msmin"] is None and "comment" not in d
    assert json.loads(json.dumps(d)) == d
    assert export.rfc3339(1784014200 * 10**9, "Europe/Paris") == "2026-07-14T09:30:00+02:00" and export.rfc3339(None) == export.NO_INSTANT
    assert export.series_dict(Signal(empty(spark), "none")) == {"id": "", "name": "none", "chron": [], "meas": []}


def test_text(spark):
    s = Signal(every_minute(spark, 1, None, NAN, 2.5), "raw")
    text = show.series_text(s).splitlines()
    assert [x.strip() for x in text[3].split("|")] == ["1", "2026-01-01 00:01:00", "NaV", "1m0s", "NaV"] and len(text) == 6 and "NaDuration" in text[2]
    assert show.series_text(s, 1, 3).endswith("2 of 4 points") and show.series_text(s, 9, 12) == "raw\nno points" and "no readings" in show.series_text(Signal(empty(spark)))
    told = show.stats_text(s.stats().first(), "raw").splitlines()
    assert told[0] == "raw: 4 readings, of which 1 NaV and 1 NaN" and told[1].startswith("(a NaN") and told[2] == "Values" and "smallest | NaN | (—)" in told[3]
    assert show.whole_text(s, 2).count("of which") == 1 and "2 of 4 points" in show.whole_text(s, 2)


def test_rfc3339(spark):
    at = [0, 1, ORIGIN + 5 * 10**8, -1, 10**9 - 10, None]
    rows = spark.createDataFrame([(x,) for x in at], "at long").withColumn("text", export.rfc3339_text("at")).collect()
    assert [(r["at"], r["text"]) for r in rows] == [(x, export.rfc3339(x)) for x in at]
