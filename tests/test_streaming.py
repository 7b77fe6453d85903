import random

import pytest
from helpers import HOUR, MINUTE, NAN, ORIGIN, kind, minutes
from pyspark.sql import functions as F

from gaugeworks.errors import AlarmArgumentError
from gaugeworks.operators import compress, resample
from gaugeworks.sources.readings import SCHEMA, from_rows
from gaugeworks.streaming import live
from gaugeworks.streaming.live import reduced_stream, silences_stream


def run(spark, df, path, make, name, mode="append"):
    df.coalesce(1).write.parquet(str(path))
    query = make(spark.readStream.schema(SCHEMA).parquet(str(path))).writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
        return sorted((r["chron_ns"], r["meas"]) for r in spark.table(name).collect())
    finally:
        query.stop()


def test_grid(spark, tmp_path):
    df = minutes(spark, [(30, 1), (60, 2), (61, 3), (120, 4), (600, 9), (900, 9)])
    got = run(spark, df, tmp_path / "in", lambda s: live.regularized_stream(s, "1h", "mean", watermark="1 minute"), "grid")
    whole = {(r["chron_ns"], r["meas"]) for r in resample.regularize(df, "1h").collect()}
    assert got[:2] == [(ORIGIN + HOUR, 1.5), (ORIGIN + 2 * HOUR, 3.5)] and set(got) <= whole


def test_whole_microseconds(spark):
    """A step of 1 ms far from 1970: no detour through doubles."""
    at = [1704067200002000000, 1704067200002000999, -1, -1000]
    rows = spark.createDataFrame([(x,) for x in at], "x long").select(live._micros(F.col("x")).alias("m")).collect()
    assert [r["m"] for r in rows] == [x // 1000 for x in at]


def test_alarm(spark, tmp_path):
    df = minutes(spark, [(0, 1), (10, 1), (60, 2), (70, 2)])
    got = run(spark, df, tmp_path / "in", lambda s: live.silences_stream(s, "15m"), "alarms")
    assert (ORIGIN + 25 * MINUTE, None) in got
    with pytest.raises(AlarmArgumentError):
        live.silences_stream(df, 0)


def test_arrival_out_of_order(spark, tmp_path):
    """Readings shuffled within the watermark, a file at a time: what a batch gives, and one alarm at the end of each series."""
    r = random.Random(4)
    points = sorted({ORIGIN + r.randrange(3000) * 10**9: r.choice([None, NAN, 1.0, 1.0, 2.0, 5.0]) for _ in range(250)}.items())
    whole = from_rows(spark, points)
    late = sorted(range(len(points)), key=lambda i: points[i][0] + r.randrange(250) * 10**9)
    source = str(tmp_path / "in")
    for k, low in enumerate(range(0, len(late), 25)):
        rows = [("s", i, points[i][0], points[i][1]) for i in late[low : low + 25]]
        spark.createDataFrame(rows, whole.schema).coalesce(1).write.parquet(f"{source}/{k:03d}")
    for k, hours in enumerate((9, 18)):  # another series' readings move the watermark on
        spark.createDataFrame([("clock", 0, ORIGIN + hours * HOUR, None)], whole.schema).coalesce(1).write.parquet(f"{source}/{900 + k}")
    for name, live, batch in (
        ("silences", lambda d: silences_stream(d, "20s", "300 seconds"), [(x["chron_ns"], "gap") for x in compress.mark_silences(whole, "20s").exceptAll(whole).collect()]),
        ("changes", lambda d: reduced_stream(d, 1.5, "300 seconds"), None),
    ):
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        query = live(stream).filter("series_id = 's'").writeStream.format("memory").queryName(f"order_{name}").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        told = sorted((x["chron_ns"], kind(x["meas"])) for x in spark.table(f"order_{name}").collect())
        if batch is None:
            batch = sorted((x["chron_ns"], kind(x["meas"])) for x in compress.reduce_with_deadband(whole, 1.5).collect())
            assert told in (batch, batch[:-1])  # a batch keeps the last reading in any case
        else:
            end = [(points[-1][0] + 20 * 10**9, "gap")] if points[-1][1] is not None else []
            assert told == sorted(batch + end)
