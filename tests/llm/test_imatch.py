"""I-Match fingerprints against their SQL on odd rows, and what they are for: equal texts agree, edited ones somewhat, others not."""

import random

import duckdb
import pytest
from plain import prose

from gaugeworks.llm import imatch

R = random.Random(4)
TEXTS = [None, "", "", "  ", "Größe ÉCOLE", "one", "same text here", "same text here", prose(R, 3000), *(prose(R, 80) for _ in range(30))]
SCHEMA = "doc_id long, text string, term string, mask int"


def both(spark, docs, **kwargs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    mine = [tuple(r) for r in imatch.fingerprints(df, **kwargs).collect()]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    if docs:
        c.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    key = lambda r: tuple(map(str, r))
    return sorted(mine, key=key), sorted(c.sql(imatch.OP12_SQL).fetchall(), key=key)


@pytest.mark.parametrize("rows", [7, 100_000])
def test_against_sql(spark, rows):
    mine, theirs = both(spark, list(enumerate(TEXTS)), rows=rows)
    assert mine == theirs


def test_repeated_and_null_ids(spark):
    """Many rows of one id and many without one; runs are cut inside them."""
    rows = [(5, t) for t in TEXTS] + [(None, t) for t in TEXTS[:20]] + [(i, t) for i, t in enumerate(TEXTS)] + [(5, "same text here")] * 4
    mine, theirs = both(spark, rows, rows=6)
    assert mine == theirs


def test_large_lexicon_is_joined(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", 0)
    mine, theirs = both(spark, list(enumerate(TEXTS)), rows=9)
    assert mine == theirs


def test_few_rows(spark):
    assert both(spark, []) == ([], [])
    for rows in ([(1, "alone and edited by itself")], [(1, None)], [(2, "a b c d"), (1, "")]):
        mine, theirs = both(spark, rows)
        assert mine == theirs and all(0 <= x <= 1 for r in mine for x in r[5:])


def test_likeness(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    docs = [" ".join(r.choices(words, k=120)) for _ in range(400)]
    told = imatch.fingerprints(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    edited, other = (sum(r[c] for r in told) / len(told) for c in ("near_edited", "near_next"))
    assert edited > 0.05 > 5 * other
    same = {}
    for d in imatch.fingerprints(spark.createDataFrame([(i, docs[i % 7]) for i in range(40)], "doc_id long, text string")).collect():
        assert same.setdefault(d["doc_id"] % 7, d["fingerprint"]) == d["fingerprint"]
