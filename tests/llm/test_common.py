import random

import pytest

from gaugeworks import storage
from gaugeworks.llm import common


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("least", [0, 1_000])
def test_keyed_join(spark, monkeypatch, how, least):
    """Hot keys, null keys, keys without a match: as a plain join answers."""
    monkeypatch.setattr(storage, "HOT_LEAST", least)
    r = random.Random(1)
    rows = [(r.choice(["a"] * 16 + ["b", "c", None]), r.choice([1] * 9 + [2]), i) for i in range(400)]
    left = spark.createDataFrame(rows, "k string, l int, i int")
    right = spark.createDataFrame([("a", 1, 10.0), ("b", 2, 20.0), ("z", 1, 30.0), (None, 1, 40.0)], "k string, l int, v double")
    got = common.keyed_join(left, right, ["k", "l"], how).select("k", "l", "i", "v").collect()
    assert sorted(map(str, got)) == sorted(map(str, left.join(right, ["k", "l"], how).select("k", "l", "i", "v").collect()))
    counted = right.join(left.groupBy("k", "l").count().withColumnRenamed("count", "__rows"), ["k", "l"])
    assert sorted(map(str, common.keyed_join(left, counted, ["k", "l"]).select("k", "l", "i", "v").collect())) == sorted(map(str, left.join(right, ["k", "l"]).select("k", "l", "i", "v").collect()))
    assert common.keyed_join(left.limit(0), right, ["k", "l"], how).collect() == []


def test_shared_folder(monkeypatch):
    """A cluster without a named folder is an error, not a folder that others can't see."""

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
