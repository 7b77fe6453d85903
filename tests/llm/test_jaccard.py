import random
import re

import numpy as np
import pyarrow as pa
import pytest
from plain import groups, near_copies, shingles

from gaugeworks import storage
from gaugeworks.llm import jaccard, wordhash
from gaugeworks.llm.common import slices, text_bytes
from gaugeworks.llm.components import components


def test_words_and_shingles():
    texts = ["", "Á b\tC", None, "one", "a b c d a b c", "x\x0by\x0cz\r\n w", "é" * 9, "Tail ", " a"]
    for most in (3, 7, 2_000_000):
        h, n = wordhash.words(*text_bytes(pa.array(texts)), most)
        assert n.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
        ends = np.cumsum(n)
        assert [len(wordhash.shingles(h[e - k : e], 3)) for e, k in zip(ends, n)] == [len(shingles(t, 3)) for t in texts]
    h, _ = wordhash.words(*text_bytes(pa.array(["The the THE tHe then"])))
    assert len(set(h[:4].tolist())) == 1 and h[4] != h[0]


def test_slices():
    assert list(slices([], 5)) == [] and list(slices([0, 0], 5)) == [(0, 2)] and list(slices([9, 1, 1, 9], 5)) == [(0, 1), (1, 3), (3, 4)]


@pytest.mark.parametrize(("shingle", "num", "seed"), [(3, 90, 1), (5, 80, 2), (1, 60, 3)])
def test_against_all_pairs(spark, shingle, num, seed):
    docs = near_copies(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, cid string")
    out = {(r["doc_id"]): r for r in jaccard.ngram_jaccard_join(df, shingle=shingle, num=num).collect()}
    component, sizes = groups(docs, shingle, num, 100)
    assert len(out) == len(docs)
    for (d, _), c, n in zip(docs, component, sizes):
        assert (out[d]["component_id"], out[d]["n_shingles"]) == (c, n), d


def test_small_sets_by_subsets(spark, monkeypatch):
    """With every set up to 24 made small, the subsets alone must find their links."""
    monkeypatch.setattr(jaccard._Join, "boundary", lambda self, first: 24)
    r = random.Random(4)
    docs = []
    for i in range(60):
        w = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(8, 30))]
        docs += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(w[:-1])), (3 * i + 2, " ".join([*w[1:], "other"]))]
    out = {r["doc_id"]: r["component_id"] for r in jaccard.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), shingle=1, num=90).collect()}
    assert [out[d] for d, _ in docs] == groups(docs, 1, 90, 100)[0]


def test_cost_chooses_small_sets(spark):
    """Short texts that differ by a word cost a few subsets each; long ones cost too many. Both halves find links."""
    r = random.Random(6)
    docs = []
    for i in range(50):
        w = [f"w{r.randrange(10**6)}" for _ in range(r.choice([10, 11, 19, 60, 900]))]
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-1]))]
    told = {}
    out = {r["doc_id"]: r["component_id"] for r in jaccard.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), shingle=1, num=90, told=told).collect()}
    assert [out[d] for d, _ in docs] == groups(docs, 1, 90, 100)[0]
    assert told["subset_links"] > 5 and told["scan_links"] > 5 and 60 <= told["boundary"] < 899 and told["candidates"] == 100


@pytest.mark.parametrize(("shingle", "num"), [(3, 90), (2, 50)])
def test_elements_joined(spark, monkeypatch, shingle, num):
    """Too many shared elements for a filter: the same result by joins."""
    monkeypatch.setattr(jaccard, "FILTER_MOST", 0)
    monkeypatch.setattr(jaccard, "HEAVY_MOST", 9)
    monkeypatch.setattr(storage, "HOT_LEAST", 5)
    docs = near_copies(9)
    out = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jaccard.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), shingle=shingle, num=num).collect()}
    assert [out[d] for d, _ in docs] == list(zip(*groups(docs, shingle, num, 100)))


def test_hot_keys(spark, monkeypatch):
    """A passage in most texts, and a hub of near copies, dealt to several tasks."""
    monkeypatch.setattr(storage, "HOT_LEAST", 5)
    monkeypatch.setattr(jaccard, "PAIRS_LEAST", 10)
    docs = near_copies(7)
    out = {r["doc_id"]: r["component_id"] for r in jaccard.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), shingle=3, num=80).collect()}
    assert [out[d] for d, _ in docs] == groups(docs, 3, 80, 100)[0]


@pytest.mark.parametrize("most", [0, 10**6])
def test_any_boundary(spark, monkeypatch, most):
    """Wherever the boundary lies, the result is the same."""
    monkeypatch.setattr(jaccard._Join, "boundary", lambda self, first: most)
    docs = near_copies(8)
    out = {r["doc_id"]: r["component_id"] for r in jaccard.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), shingle=3, num=80).collect()}
    assert [out[d] for d, _ in docs] == groups(docs, 3, 80, 100)[0]


def test_rounds_of_strays(spark, monkeypatch):
    """Without room to compare the rest at once, it is compared in rounds with the same result."""
    monkeypatch.setattr(jaccard, "WORK", 0)
    monkeypatch.setattr(jaccard, "WORK_LEAST", 400)
    docs = near_copies(5)[:120]
    out = {r["doc_id"]: r["component_id"] for r in jaccard.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), shingle=3, num=80).collect()}
    assert [out[d] for d, _ in docs] == groups(docs, 3, 80, 100)[0]


def test_empty_table(spark):
    assert jaccard.ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (None, 3)]
    out = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {n: n for l in links if None not in l for n in l}
    for _ in root:
        for a, b in links:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert out == {n: root[n] for a, b in links if a is not None and a != b for n in (a, b)}
