"""Alignment against the named libraries and loops over all pairs of tokens."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from plain import prose
from tokenizers import Tokenizer

from gaugeworks.llm import alignment

R = random.Random(9)
BITS = ["the", " ", "  ", "\t", "\n", "é", "ﬁ", "▁", "\x00", "a", "b1", "123", "'s", ".", "!!", "日本", "😀", "<|endoftext|>", "<s>", "<0x41>", "　", "\xa0", "\x1c", "\x85", "Größe"]
TEXTS = [None, "", " ", "  x", "hello world", "hello world", "x▁y", "<|endoftext|> <s>", "日本語" * 400, "aa" * 700, prose(R, 2500), " ".join(["same"] * 5000), *("".join(R.choices(BITS, k=R.randrange(1, 20))) for _ in range(120))]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b, alignment.Tokens().bytes


def tokens(libraries, text):
    """((id, start, end) of A, of B), or None."""
    a, b, spelt = libraries
    if not text:
        return None
    out = []
    for ids, table in ((a.encode(" " + text, add_special_tokens=False).ids, spelt[0]), (b.encode(text), spelt[1])):
        at, side = 0, []
        for i in ids:
            side.append((i, at, at + len(table[i])))
            at += len(table[i])
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return None
        out.append(side)
    return out


def plain(libraries, rows):
    made, docs = [], Counter()
    for d, text in rows:
        got = tokens(libraries, text)
        if got is None:
            made.append((d, [], [], [], []))
            continue
        a, b = got
        links, j = [], 0
        for i, s, e in a:  # tokens of B that end after s and begin before e
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = ["|".join(",".join(str(x[0]) for x in side if low < x[2] <= high) for side in (a, b)) for low, high in zip([0, *ends], ends)] if len(a) < 3000 else None
        made.append((d, a, b, links, groups))
        docs.update(set(links))
    most = Counter()
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for d, a, b, links, groups in made:
        sha = None if groups is None else hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        ends = {x[2] for x in a} & {x[2] for x in b}
        out.append((d, len(a), len(b), len(ends), len(links), sum(docs[x] == most[x[0]] for x in links), sum(docs[x] for x in links), sha))
    return out


def compared(spark, libraries, rows):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, pair int, h string")
    mine = sorted((tuple(r) for r in alignment.aligned_counts(df).collect()), key=str)
    want = sorted(plain(libraries, rows), key=str)
    assert len(mine) == len(want)
    for m, w in zip(sorted(mine, key=lambda r: (str(r[0]), r[1:7])), sorted(want, key=lambda r: (str(r[0]), r[1:7]))):
        assert m[:7] == w[:7] and w[7] in (None, m[7])


def test_by_loops(spark, libraries):
    compared(spark, libraries, list(enumerate(TEXTS)))


def test_repeated_rows_and_ids(spark, libraries):
    compared(spark, libraries, [(1, "hello world")] * 5 + [(1, "other"), (None, "hello world"), (None, None), (None, None), (2, ""), (3, "▁")])


def test_pairs_joined_without_broadcast(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    compared(spark, libraries, list(enumerate(TEXTS[:40])))


def test_empty(spark):
    assert alignment.aligned_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_groups_and_links(spark, libraries):
    rows = [(i, t) for i, t in enumerate(TEXTS) if t and len(t) < 400]
    told = {}
    for r in alignment.alignment(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        told.setdefault(r["doc_id"], []).append(r)
    for d, text in rows:
        got = tokens(libraries, text)
        if got is None:
            assert d not in told
            continue
        parts = sorted(told[d], key=lambda r: r["first_group"])
        groups = [g for p in parts for g in p["groups"]]
        assert [i for g in groups for i in g["a"]] == [x[0] for x in got[0]] and [i for g in groups for i in g["b"]] == [x[0] for x in got[1]]
        assert [g["end"] for g in groups] == sorted({x[2] for x in got[0]} & {x[2] for x in got[1]})
        for x in (link for p in parts for link in p["links"]):
            a, b = got[0][x["a"]], got[1][x["b"]]
            assert (a[0], b[0]) == (x["a_id"], x["b_id"]) and (max(a[1], b[1]), min(a[2], b[2])) == (x["start"], x["end"])


def test_encoding_by_segments(libraries):
    """Random strings, encoded by segments and by the libraries."""
    r, made = random.Random(3), alignment.Tokens()
    texts = ["".join(r.choices(BITS, k=r.randrange(1, 14))) for _ in range(4000)]
    got: dict[int, list] = {}
    for n, a, b in made.encode(texts):
        got.setdefault(n, []).append((a, b))
    for n, text in enumerate(texts):
        want = tokens(libraries, text)
        if want is None:
            assert got[n][-1] == (None, None)
            continue
        for side in (0, 1):
            raw = b"".join(p[side] for p in got[n])
            assert [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)] == [x[0] for x in want[side]]


def test_sweep_in_small_blocks():
    """However the events are cut into blocks, the same groups close."""
    import numpy as np

    made, r = alignment.Tokens(), random.Random(2)
    for text in ("hello wonderful world, unbelievably so", "日本語 und Größe " * 9, "a" * 300):
        (_, a, b), = made.encode([text])
        whole = alignment._Summary(made)
        sweep = alignment.Sweep(made.lengths)
        sweep.feed(0, a)
        sweep.feed(1, b)
        whole.take(*sweep.settle())
        parts, sweep = alignment._Summary(made), alignment.Sweep(made.lengths)
        left = [a, b]
        while left[0] or left[1]:
            side = r.choice([s for s in (0, 1) if left[s]])
            n = 2 * r.randrange(1, 6)
            sweep.feed(side, left[side][:n])
            left[side] = left[side][n:]
            got = sweep.settle()
            if got:
                parts.take(*got)
        assert next(parts.rows())[:5] == next(whole.rows())[:5] and np.array_equal(parts.pairs, whole.pairs) and np.array_equal(parts.times, whole.times)
