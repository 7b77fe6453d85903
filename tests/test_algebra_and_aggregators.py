import pytest
from helpers import INF, NAN, every_minute, kind
from pyspark.sql import functions as F

from gaugeworks.durations import ns, written
from gaugeworks.functions import aggregators, nav


@pytest.mark.parametrize(
    ("f", "a", "b", "expected"),
    [
        (nav.add, 1.0, 2.0, 3.0), (nav.add, None, 2.0, 2.0), (nav.add, None, None, None), (nav.add, NAN, None, NAN),
        (nav.sub, 5.0, 2.0, 3.0), (nav.sub, None, 2.0, None), (nav.sub, NAN, None, NAN), (nav.sub, None, NAN, NAN),
        (nav.mul, None, 0.0, None), (nav.mul, NAN, None, NAN), (nav.mul, 2.0, 3.0, 6.0),
        (nav.div, 6.0, 3.0, 2.0), (nav.div, None, 0.0, None), (nav.div, 1.0, 0.0, INF), (nav.div, -1.0, 0.0, -INF), (nav.div, 0.0, 0.0, NAN),
        (nav.coalesce, None, 2.0, 2.0), (nav.coalesce, NAN, 2.0, NAN),
    ],
)
def test_algebra(spark, f, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    assert kind(df.select(f("a", "b").alias("x")).first()["x"]) == kind(expected)


WINDOWS = [(2.0, 4.0, 6.0), (2.0, None, 6.0), (2.0, NAN, 6.0), (None, None), (None, 5.0, 7.0, None)]
EXPECTED = {
    "mean": (4, 4, NAN, None, 6), "median": (4, 2, NAN, None, 5), "min": (2, 2, NAN, None, 5), "max": (6, 6, NAN, None, 7), "sum": (12, 8, NAN, None, 12),
    "first": (2, 2, 2, None, None), "last": (6, 6, 6, None, None), "firstusable": (2, 2, 2, None, 5), "lastusable": (6, 6, 6, None, 7), "count": (3, 2, 2, 0, 2),
}


@pytest.mark.parametrize("name", EXPECTED)
def test_aggregators(spark, name):
    for window, expected in zip(WINDOWS, EXPECTED[name]):
        df = every_minute(spark, *window).withColumn("place", F.col("seq"))
        assert kind(df.agg(aggregators.aggregator(f" {name.upper()} ")(aggregators.Frame()).alias("x")).first()["x"]) == kind(expected), window


@pytest.mark.parametrize(("window", "expected"), [((0, 2, 4, 6), 2), ((5, 5, 5), 0), ((0, None, 4, 6), 2), ((3,), None), ((0, NAN, 4), NAN)])
def test_slope(spark, window, expected):
    df = every_minute(spark, *window).withColumn("place", F.col("seq"))
    assert kind(df.agg(aggregators.slope(aggregators.Frame()).alias("x")).first()["x"]) == kind(expected)


@pytest.mark.parametrize(("window", "expected"), [((10, 10, 10), 1800), ((10, None, 10), 1200), ((None,), None), ((10, NAN), NAN)])
def test_integral(spark, window, expected):
    assert kind(every_minute(spark, *window).agg(aggregators.integral("1m")(aggregators.Frame()).alias("x")).first()["x"]) == kind(expected)


def test_names():
    assert len(aggregators.names()) == 18 and aggregators.names() == sorted(aggregators.names())
    with pytest.raises(ValueError, match="mean"):
        aggregators.aggregator("mode")


def test_durations():
    assert ns("1h30m") == 5400 * 10**9 and ns("250ms") == 250 * 10**6
    assert [written(ns(d)) for d in ("1h", "5m", "90s", "1500ms", "0s", "250ms")] == ["1h0m0s", "5m0s", "1m30s", "1.5s", "0s", "250ms"]
    assert written(None) == "NaDuration"
    with pytest.raises(ValueError):
        ns("soon")
