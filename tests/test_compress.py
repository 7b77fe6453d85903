import random

import pytest
from helpers import INF, MINUTE, NAN, ORIGIN, every_minute, got, minutes, values, want

from gaugeworks.errors import AlarmArgumentError, RegularizeArgumentError
from gaugeworks.operators import compress

at = lambda m: ORIGIN + m * MINUTE


def kept(values):
    """The places that a list of values keeps: ends and changes, each gap or error like the one before being no change."""
    same = lambda a, b: a == b or a != a and b != b
    return [i for i, v in enumerate(values) if i in (0, len(values) - 1) or not same(v, values[i - 1])]


@pytest.mark.parametrize("chunk", [None, "3m"])
@pytest.mark.parametrize("seed", range(3))
def test_reduce(spark, chunk, seed):
    """Against the definition, over long runs of numbers, gaps and errors; and held again, nothing is lost."""
    r = random.Random(seed)
    series = [v for _ in range(14) for v in [r.choice([None, NAN, INF, -INF, 4.0, 7.5])] * r.choice([1, 1, 2, 5])]
    source = every_minute(spark, *series)
    reduced = compress.reduce(source, chunk)
    assert got(reduced) == want(*((i, series[i]) for i in kept(series)))
    assert values(compress.expand(reduced, at(0), at(len(series) - 1), "1m", chunk)) == values(source)
    assert got(compress.reduce(reduced, chunk)) == got(reduced)


@pytest.mark.parametrize("chunk", [None, "2m"])
def test_expand(spark, chunk):
    df = minutes(spark, [(2, 1), (4, 2), (5, 2)])
    assert values(compress.expand(df, at(0), at(7), "1m", chunk)) == ["gap", "gap", 1, 1, 2, 2, "gap", "gap"]
    assert [m for m, _ in got(compress.expand(minutes(spark, [(0, 1), (60, 1)]), at(0), at(25), "10m", chunk))] == [0, 10, 20]
    assert values(compress.expand(minutes(spark, [(0, 1), (0, 2), (3, 3)]), at(0), at(0), "1m", chunk)) == [2]


def test_deadband_in_batches(spark):
    """State is carried from batch to batch, and begins anew with each series."""
    r = random.Random(8)
    rows = [(f"s{i % 3}", i, ORIGIN + r.randrange(10**6), r.choice([None, NAN, *[r.gauss(0, 3) for _ in range(6)]])) for i in range(900)]
    df = spark.createDataFrame(rows, "series_id string, seq long, chron_ns long, meas double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = {x["seq"] for x in compress.reduce_with_deadband(df, 2.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = set()
    for name in ("s0", "s1", "s2"):
        mine, held = sorted((c, q, m) for n, q, c, m in rows if n == name), ...
        for i, (_, q, m) in enumerate(mine):
            kind = lambda x: "gap" if x is None else "error" if x != x else "number"
            if held is ... or kind(m) != kind(held) or kind(m) == "number" and abs(m - held) > 2.0:
                held = m
                wanted.add(q)
            elif i == len(mine) - 1:
                wanted.add(q)
    assert out == wanted


#: Fixed values below: drifts within and beyond a band.
def test_deadband(spark):
    assert got(compress.reduce_with_deadband(every_minute(spark, 10, 10.2, 9.9, 10.1, 12, 12.3, 11.8, 12), 0.5)) == want((0, 10), (4, 12), (7, 12))
    assert got(compress.reduce_with_deadband(every_minute(spark, 0, 0.3, 0.6, 0.9, 1.2, 1.5), 0.5)) == want((0, 0), (2, 0.6), (4, 1.2), (5, 1.5))
    assert got(compress.reduce_with_deadband(every_minute(spark, 1, 50, -3, None, 8, 9, 10), INF)) == want((0, 1), (3, None), (4, 8), (6, 10))
    r = random.Random(3)
    series = [r.choice([None, NAN, *[r.gauss(0, 2) for _ in range(8)]]) for _ in range(120)]
    source = every_minute(spark, *series)
    assert got(compress.reduce_with_deadband(source, 0)) == got(compress.reduce(source))
    held = values(compress.expand(compress.reduce_with_deadband(source, 1.0), at(0), at(119), "1m"))
    assert all(a == b if isinstance(a, str) or isinstance(b, str) else abs(a - b) <= 1.0 for a, b in zip(held, values(source)))


@pytest.mark.parametrize("chunk", [None, "15m"])
def test_silences(spark, chunk):
    mark = lambda points: got(compress.mark_silences(minutes(spark, points), "15m", chunk))
    assert mark([(0, 1), (10, 1), (60, 2), (70, 2)]) == want((0, 1), (10, 1), (25, None), (60, 2), (70, 2))
    assert mark([(0, 1), (15, 2), (31, 3)]) == want((0, 1), (15, 2), (30, None), (31, 3))
    assert mark([(0, 1), (10, None), (60, 2)]) == want((0, 1), (10, None), (60, 2))
    assert mark([(0, NAN), (60, 2)]) == want((0, NAN), (15, None), (60, 2))


def test_arguments(spark):
    df = every_minute(spark)
    for call in (lambda: compress.reduce_with_deadband(df, -1), lambda: compress.reduce_with_deadband(df, NAN), lambda: compress.expand(df, 0, 1, 0), lambda: compress.expand(df, 1, 0, 1)):
        with pytest.raises(RegularizeArgumentError):
            call()
    with pytest.raises(AlarmArgumentError):
        compress.mark_silences(df, 0)
