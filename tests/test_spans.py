"""How long series are cut, and what is worked out span by span: summaries, ranks, the dead band."""

import math
import random

import pytest
from helpers import HOUR, INF, NAN, ORIGIN, kind
from pyspark.sql import functions as F

from gaugeworks.operators import cleaning, compress, deadband, neighbours, ranks, spans, states
from gaugeworks.operators.stats import FIELDS, from_states, stats
from gaugeworks.series import Signal
from gaugeworks.sources.readings import from_rows


def series(spark, seed=1, n=2000, gaps=True):
    r = random.Random(seed)
    return [(ORIGIN + r.randrange(n) * HOUR, r.choice([None, NAN, *[r.gauss(0, 9) for _ in range(9)]]) if gaps else r.gauss(0, 9)) for _ in range(n)]


def cut(df, rows):
    return spans.Index(spans.cuts(df, rows))


@pytest.mark.parametrize("shape", ["even", "burst", "one instant", "both"])
def test_no_span_above_twice_its_share(spark, shape):
    """2,000 readings in spans of 400, next to a series of one reading."""
    at = {"even": lambda i: i * HOUR, "burst": lambda i: i * HOUR if i < 10 else 20 * HOUR + i * 1000, "one instant": lambda i: 7 * HOUR, "both": lambda i: 5 * HOUR if i % 3 else i * 1000}[shape]
    df = from_rows(spark, [(ORIGIN + at(i), 1.0) for i in range(2000)]).unionByName(from_rows(spark, [(ORIGIN, 5.0)], "single"))
    told = spans.assigned(df, cut(df, 400)).groupBy("series_id", spans.SPAN).count().collect()
    assert {x["series_id"]: x[spans.SPAN] for x in told}["single"] is None
    sizes = [x["count"] for x in told if x["series_id"] == "s"]
    assert sum(sizes) == 2000 and 4 <= len(sizes) and max(sizes) <= 800


def test_a_chain_runs_nothing_while_it_is_built(spark):
    df = from_rows(spark, series(spark, n=300))
    tracker, group = spark.sparkContext.statusTracker(), "chain"
    spark.sparkContext.setJobGroup(group, "")
    made = Signal(df).remove_stray_points(5)[0].mark_silences("3h").interpolate("linear", "9h").reduce_with_deadband(1).reduce()
    assert not tracker.getJobIdsForGroup(group)
    assert made.spans is not None and made.df.count() and tracker.getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")


def test_stored_index(spark):
    df = from_rows(spark, series(spark)).unionByName(from_rows(spark, [(ORIGIN, 5.0)], "single"))
    assert spans.index(df, 5000).cuts is None
    made = spans.index(df, 300)
    assert [(x["series_id"], len(x["cuts"])) for x in made.cuts.collect()] == [("s", 6)]
    show = lambda d: sorted(str([kind(v) if isinstance(v, float) else v for v in x]) for x in d.collect())
    assert show(neighbours.deltas(df, made)) == show(neighbours.deltas(df, None)) == show(Signal(df).indexed(300).deltas())


def rounded(row):
    return {k: (kind(v) if v is None or v != v or math.isinf(v) else float(f"{v:.9g}")) if isinstance(v, float) or v is None else v for k, v in row.asDict().items()}


@pytest.mark.parametrize("gaps", [True, False])
def test_summaries_from_states(spark, gaps):
    """Batches of readings, each later than the one before, summed up apart and merged: as all readings at once."""
    points = sorted(((a, None if m is not None and m != m and not gaps else m) for a, m in series(spark, 3, gaps=gaps)), key=lambda p: p[0])
    instants = sorted({a for a, _ in points})
    bounds = [instants[0], instants[30], instants[31], instants[-9], instants[-1] + 1]
    whole, kept = from_rows(spark, points), None
    for low, high in zip(bounds, bounds[1:]):
        one = states.states(from_rows(spark, [p for p in points if low <= p[0] < high]), cut(whole, 500) if low == bounds[2] else None)
        kept = one if kept is None else kept.unionByName(one)
    want = stats(whole, None).first()
    assert rounded(from_states(kept).first()) == rounded(want) and list(want.asDict()) == ["series_id", *FIELDS]


def test_summaries_bracket_medians(spark, monkeypatch):
    """Where states hold marks only, medians are looked for between them."""
    df = from_rows(spark, series(spark, 4)).unionByName(from_rows(spark, series(spark, 5, 40), "other"))
    want = {x["series_id"]: rounded(x) for x in stats(df, None).collect()}
    size = cut(df, 300)
    few = states.states(df, size)
    monkeypatch.setattr(states, "MARKS", 1024)
    thin = lambda q: F.expr(f"if({q}_count > 20, transform(sequence(0, 19), i -> {q}_marks[cast(i * ({q}_count - 1) div 19 as int)]), {q}_marks)").alias(f"{q}_marks")
    kept = few.select(*(thin(c[:-6]) if c.endswith("_marks") else c for c in few.columns))
    open_ = states.merged(kept).select("series_id", F.size("__open").alias("n")).collect()
    assert {x["series_id"]: x["n"] > 2 for x in open_} == {"s": True, "other": False}
    assert {x["series_id"]: rounded(x) for x in from_states(kept, df, size).collect()} == want
    lacking = {x["series_id"]: x for x in from_states(kept).collect()}
    assert lacking["s"]["chmed"] is None and rounded(lacking["other"]) == want["other"]
    with pytest.raises(Exception, match="overlap"):
        from_states(few.unionByName(few)).collect()


def test_brackets_hold():
    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(300):
        parts = [np.round(r.normal(size=r.integers(1, 60)), 1) for _ in range(r.integers(1, 6))]
        every = np.sort(np.concatenate(parts))
        kept = [(np.sort(p)[states._places(len(p), 7)], len(p)) for p in parts]
        for rank in range(1, len(every) + 1):
            low, high = states.bracket(kept, rank)
            assert low <= every[rank - 1] <= high
            assert states.bracket([(np.sort(p), len(p)) for p in parts], rank) == (every[rank - 1],) * 2


def test_second_look_takes_the_spans_of_the_first(spark):
    """Steps from span to span, which no span holds, are counted with those inside spans."""
    r = random.Random(10)
    df = from_rows(spark, [(a + r.randrange(10**12), m) for a, m in series(spark, 8)]).unionByName(from_rows(spark, series(spark, 9, 40, gaps=False), "other"))
    size = cut(df, 60)
    thin = lambda q: F.expr(f"if({q}_count > 20, transform(sequence(0, 19), i -> {q}_marks[cast(i * ({q}_count - 1) div 19 as int)]), {q}_marks)").alias(f"{q}_marks")
    few = states.states(df, size)
    told = states.merged(states.combined(few.select(*(thin(c[:-6]) if c.endswith("_marks") else c for c in few.columns))))
    open_ = told.filter("series_id = 's'").first()["__open"]
    assert {"chron", "dchron", "meas", "dmeas"} == {x["which"] for x in open_} and all(len(x["seams_l"] or x["seams_d"]) > 9 for x in open_ if x["which"].startswith("d"))
    want = {x["series_id"]: rounded(x) for x in stats(df, None).collect()}
    assert {x["series_id"]: rounded(x) for x in states.settled(told, df, size, same=True).select("series_id", *FIELDS).collect()} == want


def test_marks_of_many_states_stay_few(monkeypatch):
    """However many states of a series a task has, it passes on so many marks of each quantity; brackets still hold, and a lone state is left as it is."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(states, "TOGETHER", 50)
    monkeypatch.setattr(states, "HELD", 400)
    r = np.random.default_rng(7)
    table = lambda n, start: pa.table({"chron_ns": np.sort(r.integers(start, start + 10**6, n)), "meas": np.round(r.normal(size=n), 2)})
    spans_ = [table(int(r.integers(1, 90)), i * 10**6) for i in range(200)]
    rows = [row for i, t in enumerate(spans_) for row in states.state_of(("s", i), t)]
    lone = next(states.state_of(("t", None), table(300, 0)))
    split = [[*states._combined(iter([*part, *extra]))] for part, extra in ((rows[::2], [lone]), (rows[1::2], []))]
    assert split[0][-1] == (*lone, *(None,) * 8)
    names = [x.split()[0] for x in states.COMBINED.replace("decimal(38,0)", "d").split(", ")]
    told = sorted((dict(zip(names, row)) for part in split for row in part if row[0] == "s"), key=lambda x: x["first_chron"])
    assert len(told) == 200
    for q in states.MEDIANS:
        assert sum(0 if x[f"{q}_marks"] is None else len(x[f"{q}_marks"]) for x in told) <= 2 * 50
    merged = states.Merged(told[0])
    for row in told[1:]:
        merged.then(states.Merged(row))
    chron, meas = (np.concatenate([t.column(c).to_numpy() for t in spans_]) for c in ("chron_ns", "meas"))
    want = {"chron": chron, "dchron": np.diff(chron), "meas": meas, "dmeas": np.diff(meas)}
    for q, (rank, low, high) in merged.medians().items():
        every = np.sort(want[q])
        assert rank == (len(every) + 1) // 2 and low <= every[rank - 1] <= high
        assert ((every >= low) & (every <= high)).mean() < 0.5


def test_missed_bracket(spark, monkeypatch):
    """A sketch that is far off: ranks below and above its brackets are found all the same."""
    df = from_rows(spark, [(ORIGIN + i, float(i % 500)) for i in range(1000)]).unionByName(from_rows(spark, [(ORIGIN + i, float(i)) for i in range(9)], "t"))
    want = {x["series_id"]: (x["a"], x["b"]) for x in cleaning.nearest_ranks(df, {"a": 10, "b": 90}).collect()}
    assert want == {"s": (49.0, 449.0), "t": (0.0, 8.0)}
    for marks in ("array(300D, 301D, 302D, 303D)", "array(300D, 301D, 100D, 101D)", "array(-5D, -4D, 900D, 901D)"):
        monkeypatch.setattr(cleaning, "bracket_marks", lambda value, percents, marks=marks: F.expr(f"any_value({marks})"))
        assert {x["series_id"]: (x["a"], x["b"]) for x in cleaning.nearest_ranks(df, {"a": 10, "b": 90}).collect()} == want


def test_ranks_read_one_span(spark, tmp_path, capsys):
    points = sorted(series(spark, 6, gaps=False), key=lambda p: p[0])
    from_rows(spark, points).orderBy("chron_ns", "seq").write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    size = spans.index(df, 250)
    look = ranks.Ranks.of(df, size)
    every = neighbours.ranked(neighbours.deltas(df, None), None).orderBy("place").collect()
    for i in (0, 1, 249, 777, 1999):
        got = look.at(i)
        assert [x["place"] for x in got.collect()] == [i] and got.first()["dmeas"] == every[i]["dmeas"] and got.first()["dchron_ns"] == every[i]["dchron_ns"]
    assert look.at(2000).collect() == []
    # Only the span's instants are asked of the file, and only its readings are numbered.
    one = look.table.filter(F.col("before") <= 777).orderBy(F.desc("before")).first()
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    look.at(777).explain()
    plan = capsys.readouterr().out
    assert f"GreaterThanOrEqual(chron_ns,{one['low']})" in plan and f"LessThanOrEqual(chron_ns,{one['high']})" in plan
    pages = look.pages(300)
    first = next(pages)
    assert first.count() <= 500 and [x["place"] for x in first.collect()] == list(range(first.count()))
    assert [x["place"] for page in look.pages(300) for x in page.collect()] == list(range(2000))
    assert [p["meas"] for p in Signal(df, chunk=size).points()] == [x["meas"] for x in every]


@pytest.mark.parametrize("seed", range(3))
def test_deadband_in_parallel(spark, seed):
    """Noise, smooth stretches longer than a span, infinities and gaps, cut into many spans: as in one walk."""
    r = random.Random(seed)
    values, x = [], 0.0
    for i in range(1500):
        x = x + 0.01 if i % 600 < 400 else r.gauss(0, 3)
        values.append(None if r.random() < 0.004 else NAN if r.random() < 0.002 else r.choice([INF, -INF]) if r.random() < 0.002 else x)
    df = from_rows(spark, [(ORIGIN + i * HOUR, v) for i, v in enumerate(values)]).unionByName(from_rows(spark, [(ORIGIN, 1.0), (ORIGIN + 1, 1.5)], "t"))
    show = lambda d: sorted((x["series_id"], x["seq"], kind(x["meas"])) for x in d.collect())
    for band in (0.0, 1.0, 2.5, 50.0, INF):
        assert show(compress.reduce_with_deadband(df, band, cut(df, 60))) == show(compress.reduce_with_deadband(df, band, None))


def test_span_maps():
    """Composed maps hold what the walk holds, at every cut."""
    r = random.Random(1)
    for _ in range(4000):
        n, band, grain = r.randrange(1, 40), r.choice([0.0, 0.3, 1.0, 2.5, INF, 0.1]), r.choice([0.1, 0.01, 1.0])
        x, values, kinds, shape = 0.0, [], [], r.choice(["walk", "noise", "ramp"])
        for _ in range(n):
            x = x + r.choice([-1, 1]) * r.random() * min(band, 9) if shape == "walk" else r.random() * 3 if shape == "noise" else x + 0.07
            values.append(r.choice([INF, -INF]) if r.random() < 0.02 else round(x / grain) * grain)
            kinds.append(0 if r.random() < 0.95 else r.choice([1, 2]))
        whole, at, held, got = deadband.walked(kinds, values, None, 0.0, band)[0], 0, 0.0, []
        for end in [*sorted(r.sample(range(1, n), min(n - 1, r.randrange(4)))), n]:
            before = (kinds[at - 1], values[at - 1]) if at else (None, 0.0)
            pieces = deadband.span_map(kinds[at:end], values[at:end], *before, band)
            kept, last, reached = deadband.walked(kinds[at:end], values[at:end], before[0], held, band)
            held, got, at = deadband.applied(pieces, held), got + kept, end
            assert last or reached == held
        assert got == whole


def test_bounds_of_a_band():
    r = random.Random(7)
    for value, band in [(0.1, 0.1), (0.0, 0.0), (5.0, 5.0), (-3.0, 3.0), (1e300, 1.0), (1.0, 1e300), *((r.gauss(0, 5), abs(r.gauss(0, 5))) for _ in range(500))]:
        low, high = deadband.within(value, band)
        assert not deadband.moved(low, value, band) and not deadband.moved(high, value, band)
        assert deadband.moved(math.nextafter(low, -INF), value, band) and deadband.moved(math.nextafter(high, INF), value, band)


def test_cuts_are_looked_into_by_blocks(spark, monkeypatch):
    """The span of each reading is the number of cuts not after it, though at most BLOCK cuts are copied beside it."""
    from bisect import bisect_right

    monkeypatch.setattr(spans, "BLOCK", 16)
    df = spark.range(3000).selectExpr("if(id % 10 = 0, 't', 's') series_id", "id seq", "id div 7 chron_ns", "1D meas")
    index = spans.Index(spans.cuts(df, 40).cache())
    known = {x["series_id"]: [tuple(c) for c in x["cuts"]] for x in index.cuts.collect()}
    assert len(known["s"]) > 3 * spans.BLOCK
    for found in (spans.assigned(df, index), spans.only_cut(df, index)):
        rows = found.collect()
        assert len(rows) == 3000 and all(x[spans.SPAN] == bisect_right(known[x["series_id"]], (x["chron_ns"], x["seq"])) for x in rows)
