import pytest
from helpers import HOUR, MINUTE, NAN, ORIGIN, got, hourly, kind, minutes, values, want

from pyspark.sql import functions as F

from gaugeworks.errors import RegularizeArgumentError
from gaugeworks.functions import aggregators
from gaugeworks.operators import resample
from gaugeworks.sources.readings import empty, from_rows


def grid(spark, points, step="1h", agg="mean", tolerance=0, chunk=None):
    return got(resample.regularize(minutes(spark, points), step, agg, tolerance, chunk))


def test_right_closed(spark):
    assert grid(spark, [(30, 1), (60, 2), (61, 3), (120, 4)]) == want((60, 1.5), (120, 3.5))


@pytest.mark.parametrize("chunk", [None, "2h"])
def test_hole(spark, chunk):
    assert grid(spark, [(30, 1), (210, 2)], chunk=chunk) == want((60, 1), (120, None), (180, None), (240, 2))


def test_drift(spark):
    points = [(57, 57), (123, 123), (180, 180), (241, 241)]
    assert grid(spark, points) == want((60, 57), (120, None), (180, 151.5), (240, None), (300, 241))
    assert grid(spark, points, tolerance="5m") == want((60, 57), (120, 123), (180, 180), (240, 241))


def test_classes(spark):
    assert grid(spark, [(10, 10), (20, None), (30, 20), (70, None), (80, None), (130, 5), (140, NAN)]) == want((60, 15), (120, None), (180, NAN))


def test_steps(spark):
    points = [(0, 1), (15, 2), (30, 3), (45, 4), (60, 5), (75, 6)]
    assert grid(spark, points, "30m") == want((0, 1), (30, 2.5), (60, 4.5), (90, 6))
    assert grid(spark, points, "24h", "sum") == want((0, 1), (1440, 20))


def test_first_window_has_no_tolerance(spark):
    assert grid(spark, [(600 + 4 / 60, 1)], tolerance="1m") == want((660, 1))


def test_grid_counts_from_year_one(spark):
    (at, _), = grid(spark, [(1, 1)], "168h")
    assert (ORIGIN + int(at) * MINUTE + resample.YEAR_ONE * 10**9) % (168 * HOUR) == 0


def test_empty(spark):
    assert got(resample.regularize(empty(spark), "1h")) == []
    assert got(resample.downscale(empty(spark), "daily")) == []


@pytest.mark.parametrize("args", [(0, "mean", 0), ("1h", None, 0), ("1h", "mean", -1), ("1h", "mean", "1h")])
def test_arguments(spark, args):
    with pytest.raises((RegularizeArgumentError, ValueError)):
        resample.regularize(empty(spark), *args)


def test_days(spark):
    days = lambda points, agg="sum": [v for _, v in got(resample.downscale_daily(minutes(spark, points), agg))]
    assert days([(720, 1), (1440, 100)]) == [1, 100]
    assert days([(720, 1), (3 * 1440 + 720, 4)]) == [1, "gap", "gap", 4]


def test_weeks_and_months(spark):
    day = 1440
    weeks = resample.downscale_weekly(minutes(spark, [(0, 1), (3 * day, 2), (4 * day, 10), (19 * day, 50)]), "sum")
    assert [(round((m + 1 / MINUTE) / day, 6), v) for m, v in got(weeks)] == [(4, 3), (11, 10), (18, "gap"), (25, 50)]
    year = 1830297600  # 2028
    leap = from_rows(spark, [((year + d * 86400) * 10**9, v) for d, v in ((30, 1), (59, 2), (60, 3), (135, 5))])
    assert values(resample.downscale_monthly(leap, "sum")) == [1, 2, 3, "gap", 5]
    assert values(resample.downscale_yearly(leap, "sum")) == [11]


def test_clock_changes(spark):
    spring = 1774652400  # 2026-03-28 00:00 in Paris
    hours = from_rows(spark, [((spring + h * 3600) * 10**9, 1) for h in range(71)])
    assert values(resample.downscale_daily(hours, "count", "Europe/Paris")) == [24, 23, 24]
    autumn = 1792792800  # 2026-10-24 00:00 in Paris
    hours = from_rows(spark, [((autumn + h * 3600) * 10**9, 1) for h in range(73)])
    assert values(resample.downscale_daily(hours, "count", "Europe/Paris")) == [24, 25, 24]
    two = minutes(spark, [(600, 1), (1200, 2)])
    assert values(resample.downscale_daily(two, "sum")) == [3] and values(resample.downscale_daily(two, "sum", "Asia/Tokyo")) == [1, 2]
    santiago = from_rows(spark, [((1788624000 + h * 3600) * 10**9, 1) for h in range(72)])
    assert sum(values(resample.downscale_daily(santiago, "count", "America/Santiago"))) == 72


def test_zone_of_each_series(spark):
    two = [(600, 1), (1200, 2)]
    df = minutes(spark, two).unionByName(minutes(spark, two).withColumn("series_id", F.lit("east")))
    zones = spark.createDataFrame([("east", "Asia/Tokyo")], "series_id string, tz string")
    out = resample.downscale(df, "daily", "sum", zones).collect()
    assert sorted((r["series_id"], r["meas"]) for r in out) == [("east", 1), ("east", 2), ("s", 3)]


def test_own_aggregators(spark):
    points = [(10, 4), (20, None), (30, NAN), (70, 1), (80, 5), (200, 2)]
    rises = aggregators.of_readings(lambda xs: F.size(F.filter(xs, lambda x: x > 1)).cast("double"))
    assert grid(spark, points, agg=rises) == want((60, 2), (120, 1), (180, None), (240, 1))  # NaN is above all numbers
    spread = aggregators.of_function(lambda xs: None if None in xs else max(xs) - min(xs))
    assert grid(spark, points, agg=spread) == want((60, None), (120, 4), (180, None), (240, 0))
    assert grid(spark, points, agg=aggregators.of_function(lambda xs: float("nan")))[0] == (60.0, "error")
    last = aggregators.placed(lambda f: F.max(f.place).cast("double"))
    assert grid(spark, points, agg=last) == want((60, 2), (120, 1), (180, None), (240, 0))


def test_end_of_period(spark):
    (end,) = [r["chron_ns"] for r in resample.downscale_daily(hourly(spark, 1), "sum").collect()]
    assert end == ORIGIN + 24 * HOUR - 1 and kind(1.0) == 1
