"""The divergence audit against loops over all kept terms of all pairs of sources."""

import random
import re
from collections import Counter, defaultdict

import pytest

from gaugeworks.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, value int"


def plain(rows, ranks=200):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held, counts = Counter(), defaultdict(Counter)
        for at, source, terms in docs:
            if at == lang:
                held.update(set(terms))
                counts[source].update(terms)
        kept = sorted((t for t, n in held.items() if n >= 3), key=str.encode)
        every = Counter()
        for c in counts.values():
            every.update({t: c[t] for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[t] for t in kept) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(every)
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ordered) if part == "pair" or i < ranks]
    return sorted(out)


def told(spark, rows, **kwargs):
    df = spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in divergence.divergence(df, **kwargs).collect())


@pytest.mark.parametrize("seed", range(2))
def test_by_loops(spark, seed):
    r = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "größe", "x9y", "日本", "rare", "a-b", "  ", "1"]
    text = lambda: " ".join(r.choice(words[: r.randrange(1, 12)]) for _ in range(r.choice([0, 1, 5, 40])))
    rows = [(r.choice([None, text(), text(), text()]), r.choice(["en", "en", None, "", "de"]), r.choice(["hot", "hot", "b", None, "", "c"])) for _ in range(60)]
    rows += [("the the of " * 3, "en", "hot")] * 30
    assert told(spark, rows) == plain(rows) and len(plain(rows)) > 60
    assert told(spark, rows, ranks=2) == plain(rows, 2)


def test_groups_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    rows = [("a b c", "en", s) for s in ("x", "x", "x", "y")] + [("b c d", "en", "y")] * 3 + [("", "fr", "z"), (None, "fr", "w")]
    assert told(spark, rows) == plain(rows)


def test_empty_and_long(spark):
    assert told(spark, []) == []
    rows = [("word " * 300_000, "en", "x"), ("word other", "en", "y"), ("a" * 50_000 + " word", "en", "y")]
    assert told(spark, rows) == plain(rows)


def test_cuts_fall_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "CUT_CHARS", 4)
    for text in ("ab cd-ef ghijklm no", "abcdefghijkl", "", "a b c d e f g"):
        pieces = list(divergence._cut(text))
        assert "".join(pieces) == text and [t for p in pieces for t in re.findall("[a-z]+", p)] == re.findall("[a-z]+", text)


def test_shares_and_values_are_of_64_bits():
    """Also at the ends: a share of all occurrences against the least one. 128 bits cost most of the time of the pairs."""
    n = 10**12
    p, q = divergence._share(f"{n}::BIGINT", f"{n}::BIGINT", "1::BIGINT"), divergence._share("0::BIGINT", f"{n}::BIGINT", "1::BIGINT")
    told = divergence.duckdb.sql(f"SELECT p, q, f, typeof(p), typeof(f) FROM (SELECT p, q, {divergence._value('p', 'q')} AS f FROM (SELECT {p} AS p, {q} AS q))").fetchall()
    assert told == [(10**9 + 1, 1, 10**18, "BIGINT", "BIGINT")]


def counted(rows):
    """Occurrences and rows by language, source and term, by a loop."""
    n, docs = Counter(), Counter()
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        n.update((lang, source, t) for t in terms)
        docs.update((lang, source, t) for t in set(terms))
    return {k: (n[k], docs[k]) for k in n}


def listed(counts):
    terms = counts.terms.to_pylist()
    return {(*counts.groups[g], terms[t]): (n, d) for t, g, n, d in zip(counts.term.tolist(), counts.group.tolist(), counts.n.tolist(), counts.docs.tolist())}


def some_rows(seed, many=200):
    r = random.Random(seed)
    words = ["the", "The", "THE", "of", "é", "É", "größe", "x9y", "日本", "rare", "a-b", " ", "1", "\x00", "@[`{\x7f"]
    return [(r.choice(["en", "", "d\n"]), r.choice(["x", "", "é y", "z"]), r.choice([" ", ""]).join(r.choice(words) for _ in range(r.choice([0, 1, 1, 9, 60])))) for _ in range(many)]


@pytest.mark.parametrize("cut, find", [(1_000_000, 400_000), (4, 10), (1, 1)])
def test_terms_of_parts_and_pieces(monkeypatch, cut, find):
    """No term crosses from one text into the next, and a text looked at in pieces is one row."""
    monkeypatch.setattr(divergence, "CUT_CHARS", cut)
    monkeypatch.setattr(divergence, "FIND_CHARS", find)
    rows = some_rows(cut)
    parts = [divergence._counted(*map(list, zip(*rows[at : at + 70]))) for at in range(0, len(rows), 70)]
    merged = divergence._merged(parts)
    assert listed(merged) == counted(rows) and len(merged.n) == len(counted(rows)) > 50
    some = divergence.np.arange(0, len(merged.n), 3)
    told = divergence._unblocked(divergence._block(merged, some))
    assert len(told.n) == len(some) and listed(told).items() <= counted(rows).items()
    assert listed(divergence._merged([told, told])) == {k: (2 * n, 2 * d) for k, (n, d) in listed(told).items()}


def test_rows_without_terms():
    none = divergence._counted(["en", "de"], ["x", "y"], ["", "1 2"])
    assert len(none.n) == 0 and len(divergence._merged([none, none]).n) == 0


def test_order():
    np = divergence.np
    for key in ([], [3, 1, 3, 0], [1 << 62, 5, 1 << 62, 0], [0]):
        key = np.array(key, np.int64)
        assert divergence._order(key).tolist() == np.argsort(key, kind="stable").tolist()


def test_counts_travel_as_blocks(spark):
    """A task passes on a row for each shard, not for each count: rows of counts cost more than the counting did."""
    rows = [("en", s, " ".join(f"word{chr(97 + i)}{chr(97 + j)}" for j in range(26))) for i in range(26) for s in "xyz"]
    told = divergence.term_counts(spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1), 4).collect()
    assert sorted(r.shard for r in told) == [0, 1, 2, 3]
    parts = [divergence._unblocked(r.block) for r in told]
    assert listed(divergence._merged(parts)) == counted(rows) and len(counted(rows)) == 3 * 26 * 26
    shards = [{k[::2] for k in listed(p)} for p in parts]
    assert sum(map(len, shards)) == len(set().union(*shards))  # all counts of a term in one shard
