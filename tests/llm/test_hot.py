"""One key with most of the rows, for operators that join by key; and a classifier's sample that stays bounded."""

import random

import corpus_pipeline
import pytest
from plain import prose

from gaugeworks import storage
from gaugeworks.llm import ledger, licences, quality, tokens


def shown(df):
    return sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())


def test_sample_is_bounded_and_the_same(spark, monkeypatch):
    """Ids with thousands of rows, contradictory labels, null and long texts: one row an id, no more than asked for, whatever the order."""
    r = random.Random(2)
    docs = [(i % 3, prose(r, 5) if i % 5 else None) for i in range(3000)] + [(7, "word " * 200_000), (8, "short"), (9, "zz"), (9, "aa")]
    labels = [(0, 1), (0, 0), (1, 0), (2, 1), (7, 1), (8, 0), (9, 1), (9, None), (None, 1)]
    seen = []
    monkeypatch.setattr(quality, "fit_features", lambda shape, sizes, at, values, targets: seen.append((sizes.tolist(), targets.tolist(), shape.round(9).tolist())))
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    fit = lambda d, m, **k: quality.fit_on_labels(d, m, {"good": m["quality"]}, **k)
    fit(df, marks)
    fit(df.orderBy("text").repartition(3), marks.orderBy("quality"))
    fit(df, marks, rows=2)
    fit(df, marks, size=100_000)
    key = lambda s: sorted(zip(map(tuple, s[1]), map(tuple, s[2])))
    assert [len(s[0]) for s in seen[:3]] == [6, 6, 2] and key(seen[0]) == key(seen[1])
    assert sorted(y for (y,), _ in key(seen[0])) == [0, 0, 1, 1, 1, 1]
    assert len(seen[3][0]) <= 5


@pytest.mark.parametrize("hot", [3, 10**6])
def test_hot_digests(spark, monkeypatch, hot):
    monkeypatch.setattr(storage, "HOT_LEAST", hot)
    monkeypatch.setattr(ledger, "BROADCAST_FINDINGS", 0)
    texts = [None, "", "password=abcdef", "one two", "Größe"] + [""] * 60 + ["token: zzzzzz9"] * 90
    docs = spark.createDataFrame([(i, t, {"a": 1}) for i, t in enumerate(texts)], "doc_id long, text string, m map<string,int>")
    count = tokens.shared_counter("word_bpe_49k.json")
    want = sorted((i, count([t or ""])[0]) for i, t in enumerate(texts))
    first, cache = tokens.token_counts(docs.filter("doc_id < 4"), "word_bpe_49k.json")
    for known in (None, cache):
        assert sorted((x["doc_id"], x["n_tokens"]) for x in tokens.token_counts(docs, "word_bpe_49k.json", cache=known)[0].collect()) == want
    assert first.count() == 4 and cache.columns == ["digest", "n_tokens"]
    found, known = ledger.scan_versions(docs.filter("doc_id < 4"))
    for before in (None, known):
        told = ledger.scan_versions(docs, before)[0].collect()
        assert sorted((x["doc_id"], len(x["findings"])) for x in told) == [(i, len(ledger.find_secrets(t or ""))) for i, t in enumerate(texts)]


def test_hot_root_folder(spark, monkeypatch):
    """All files lie below the root, whose licence they take."""
    files = [("LICENSE", licences.TEMPLATES["MIT"])] + [(f"d{i % 3}/f{i}", f"nothing to see {i}") for i in range(60)] + [("d1/COPYING", licences.TEMPLATES["Apache-2.0"])]
    df = spark.createDataFrame(files, "path string, text string")
    want = shown(licences.scan_licences(df))
    monkeypatch.setattr(storage, "HOT_LEAST", 3)
    monkeypatch.setattr(licences, "BROADCAST_ROWS", 0)
    assert shown(licences.scan_licences(df)) == want
    assert {x["licence_file"] for x in licences.scan_licences(df).filter("origin = 'inherited'").collect()} == {"LICENSE", "d1/COPYING"}


def test_rows_of_one_id(spark):
    """The greatest text stays, whatever the order."""
    docs = spark.createDataFrame([(1, "b b b b b b", "en"), (1, "c c c c c c", "en"), (1, None, "de"), (2, "x y z w v u", "en"), (None, "q", "en"), (None, "q", "fr")], "doc_id long, text string, lang string")
    for df in (docs, docs.orderBy("text")):
        assert shown(corpus_pipeline.distinct(spark, df, "")) == sorted([("1", "en", "c c c c c c"), ("2", "en", "x y z w v u"), ("None", "en", "q"), ("None", "fr", "q")])
