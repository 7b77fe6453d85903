import random

from plain import contamination, prose

from gaugeworks.llm import decontaminate as d


def run(spark, docs, bench):
    out = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    return [(r["doc_id"], (r["n_words"], r["n_hit"], list(r["items"])), r["contaminated"], r["spans"]) for r in out.collect()]


def test_against_all_windows(spark):
    r = random.Random(2)
    bench = [(i, prose(r, r.choice([1, 4, 7, 9, 10, 11, 30]), 10**5)) for i in range(30)]
    bench += [(100, "the the the the the the the the the the the"), (101, None), (102, ""), (103, "..."), (None, prose(r, 12)), (104, bench[3][1]), (105, "Ünï cödé Straße ÉCOLE x1 y2 z3 a4 b5 c6 d7")]
    docs = []
    for i in range(80):
        w = prose(r, r.choice([0, 3, 20, 90]), 10**5).split()
        for _ in range(r.randrange(3)):
            t = (r.choice(bench)[1] or "").split()
            a = r.randrange(len(t) + 1)
            w[a:a] = t[r.randrange(3) :] if r.random() < 0.5 else t
        docs.append((i, " ".join(w).upper() if i % 3 else ", ".join(w)))
    docs += [(200, None), (201, ""), (202, "the " * 60), (203, "ünï CÖDÉ straße école X1 y2 z3 a4 b5 c6 d7"), (203, "ünï CÖDÉ straße école X1 y2 z3 a4 b5 c6 d7"), (0, docs[5][1]), (None, docs[6][1])]
    out = run(spark, docs, bench)
    assert sorted((str(i), x) for i, x, _, _ in out) == sorted((str(i), contamination(t, bench)) for i, t in docs)
    assert all((x[1] > 0) == c and x[1] == len({p for s in spans for p in range(s["start"], s["end"])}) for _, x, c, spans in out)
    assert contamination(docs[-4][1], bench)[2] == [] and sum(c for _, _, c, _ in out) > 20


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    bench = [(1, "a b c d e f g h i j k l"), (2, "q r")]
    docs = [(1, "x a b c d e f g h i j y"), (2, "a b c d e f g h i"), (3, "q r q r")]
    assert sorted((i, x) for i, x, _, _ in run(spark, docs, bench)) == [(i, contamination(t, bench)) for i, t in docs]


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == [] and [x[:3] for x in run(spark, [(1, "a b")], [])] == [(1, (2, 0, []), False)]
