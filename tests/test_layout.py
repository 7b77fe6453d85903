"""Stored order, and late batches merged into stored deltas."""

import random

from helpers import HOUR, NAN, ORIGIN, kind

from gaugeworks.operators import compress, fill, neighbours
from gaugeworks.series import Signal
from gaugeworks.sources import layout
from gaugeworks.sources.readings import append, from_rows

COLUMNS = ("series_id", "seq", "chron_ns", "meas", "dchron_ns", "dmeas")


def shown(df, columns):
    return sorted(str([kind(v) if isinstance(v, float) else v for v in x]) for x in df.select(*columns).collect())


def some(r, n, span=2000):
    return [(ORIGIN + r.randrange(span) * HOUR, r.choice([None, NAN, *[r.gauss(0, 9) for _ in range(9)]])) for _ in range(n)]


def test_stored_order(spark, capsys):
    r = random.Random(3)
    df = from_rows(spark, some(r, 1500)).unionByName(from_rows(spark, some(r, 40), "t")).unionByName(from_rows(spark, [(ORIGIN, 1.0)], "single"))
    kept = layout.store(df, "ordered_readings", rows=300, buckets=4)
    steps = {"deltas": neighbours.deltas, "reduce": compress.reduce, "linear": lambda d: fill.interpolate(d, "linear"), "silences": lambda d: compress.mark_silences(d, "3h")}
    for name, step in steps.items():
        columns = [c for c in step(df).columns if c in COLUMNS]
        assert shown(step(kept), columns) == shown(step(df), columns), name
    assert shown(Signal(kept).mark_silences("3h").reduce().df, COLUMNS[:4]) == shown(compress.reduce(compress.mark_silences(df, "3h")), COLUMNS[:4])
    # Readings are neither exchanged nor, in their own order, sorted: what is exchanged is aggregated first.
    neighbours.deltas(kept).explain("simple")
    plan = [line for line in capsys.readouterr().out.splitlines() if "+-" in line or ":-" in line]
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(plan):
        if "Exchange" in line:
            below = [x for x in plan[i + 1 :] if depth(x) > depth(line)]
            assert any("Aggregate" in x for x in below), line
    window = next(i for i, line in enumerate(plan) if " Window " in line and "__near0" in line)
    scan = next(i for i in range(window, len(plan)) if "FileScan" in plan[i])
    assert not any(" Sort " in line or "Exchange" in line for line in plan[window + 1 : scan]) and scan <= window + 2


def test_late_batches(spark, tmp_path):
    """Random batches, late and early, one of them twice: as if all had been there from the start."""
    r = random.Random(8)
    kept, every = layout.LateTable(spark, str(tmp_path / "late"), "2d", parts=3), None
    batches = [("s", some(r, 400)), ("t", some(r, 60)), ("s", some(r, 3)), ("s", [(ORIGIN - 40 * HOUR, 2.0), (ORIGIN + 9999 * HOUR, NAN)]), ("t", some(r, 2) + some(r, 1) * 2), ("new", [(ORIGIN, None)])]
    sizes = []
    for number, (name, points) in enumerate(batches):
        batch = from_rows(spark, points, name)
        sizes.append(kept.merge(batch, number + 1))
        if number in (2, 4):
            assert kept.merge(batch, number + 1) == sizes[-1]
        every = batch if every is None else append(every, batch)
        columns = [c for c in COLUMNS if c != "seq"]
        assert shown(kept.readings(), columns) == shown(neighbours.deltas(every, None), columns), number
    # A batch of three rewrites its spans and what follows them, not the series.
    assert sizes[2] < 100 and sizes[3] < 60
    assert {(x["series_id"], x["n"]) for x in kept.index().groupBy("series_id").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()} == {("s", 405), ("t", 64), ("new", 1)}


def test_late_batches_from_a_stream(spark, tmp_path):
    r = random.Random(5)
    source = str(tmp_path / "in")
    first, second = from_rows(spark, some(r, 50)), from_rows(spark, some(r, 5))
    kept = layout.LateTable(spark, str(tmp_path / "late"), "20d")
    for batch in (first, second):
        batch.coalesce(1).write.mode("append").parquet(source)
        kept.follow(spark.readStream.schema(first.schema).parquet(source), str(tmp_path / "checkpoint")).awaitTermination()
    columns = [c for c in COLUMNS if c != "seq"]
    assert shown(kept.readings(), columns) == shown(neighbours.deltas(append(first, second), None), columns)
