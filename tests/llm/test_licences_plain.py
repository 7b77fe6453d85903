"""Licence scans against a plain version of the whole operator: lines, leading comments, whole files, every word's own weight, inheritance."""

import math
import os
import random
import re
from collections import Counter

import pytest
from plain import prose

from gaugeworks.llm import licences

BLANK = " \t\n\x0b\f\r"


def terms(text):
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def comment(text):
    """The comment that a file begins with, found by walking."""
    if text.startswith("#!") and "\n" in text:
        text = text[text.index("\n") + 1 :]
    text = text.lstrip(BLANK)
    for a, b, many in (("/*", "*/", True), ("<!--", "-->", True), ('"""', '"""', False), ("'''", "'''", False)):
        if text.startswith(a):
            at = 0
            while text.startswith(a, at) and (end := text.find(b, at + len(a))) >= 0:
                at = end + len(b)
                while many and at < len(text) and text[at] in BLANK:
                    at += 1
                if not many:
                    break
            return text[:at]
    kept = []
    for line in re.split("\r?\n", text):
        bare = line.lstrip(BLANK)
        if bare and not bare.startswith(("#", "//", "--", ";", "%")):
            break
        kept.append(line)
    return "\n".join(kept)


def plain(files):
    once = {}
    for p, t in files:
        if p is not None:
            once[p] = max(once.get(p, ""), t or "")
    n, seen = len(once), Counter()
    for t in once.values():
        seen.update(set(terms(t)))
    idf = lambda w: math.log((1 + n) / (1 + seen[w])) + 1
    vector = lambda t: {w: k * idf(w) for w, k in Counter(terms(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    notices = list(licences.TEMPLATES.items())
    named = [(name, t) for name in {*licences.HEADERS, *licences.full_texts()} for t in (*licences.HEADERS.get(name, ()), *licences.full_texts().get(name, ()))]
    titled = [(name, t) for name, ts in licences.TITLES.items() for t in ts]
    scopes = {"line": notices + titled, "block": notices + named, "whole": named}
    made = {s: [(name, vector(t)) for name, t in ts] for s, ts in scopes.items()}
    made = {s: [(name, v, norm(v)) for name, v in ts] for s, ts in made.items()}

    def best(text, scope):
        v = vector(text)
        if not v:
            return None
        got = [(-round(sum(x * u.get(w, 0) for w, x in v.items()) / (size * norm(v)), 9), name) for name, u, size in made[scope]]
        got = [g for g in got if -g[0] >= licences.THRESHOLD]
        return (*min(got), len(terms(text))) if got else None

    own, givers = {}, {}
    for p, t in once.items():
        lines = [b for b in (best(x, "line") for x in re.split("\r?\n", t)) if b]
        wide = [b for b in (best(comment(t), "block") if comment(t) else None, best(t, "whole")) if b]
        if lines or wide:
            c, name, _ = min(lines + wide)
            own[p] = (name, -c, len(lines))
            if max(sum(b[2] for b in lines), max((b[2] for b in wide), default=0)) >= 0.5 * len(terms(t)):
                folder = p[: p.rfind("/") + 1]
                givers[folder] = min(givers.get(folder, (p, name)), (p, name))
    out = {}
    for p in once:
        if p in own:
            out[p] = (*own[p], "own", None)
            continue
        folder = p[: p.rfind("/") + 1]
        while folder not in givers and folder:
            folder = folder[: folder[:-1].rfind("/") + 1]
        out[p] = (givers[folder][1], None, 0, "inherited", givers[folder][0]) if folder in givers else (None, None, 0, "none", None)
    return out


def compared(df, files):
    got, want = {r["path"]: r for r in licences.scan_licences(df).collect()}, plain(files)
    assert got.keys() == want.keys()
    for p, (licence, cosine, lines, origin, given) in want.items():
        r = got[p]
        assert (r["licence"], r["lines"], r["origin"], r["licence_file"]) == (licence, lines, origin, given), (p, r)
        assert (r["cosine"] is None) == (cosine is None) and (cosine is None or abs(r["cosine"] - cosine) < 1e-6)
    return Counter(w[3] for w in want.values())


def some_file(r):
    pick = r.choice
    text = pick([pick(list(licences.TEMPLATES.values())), *pick(list(licences.HEADERS.values())), *pick(list(licences.full_texts().values())), pick(pick(list(licences.TITLES.values())))])
    words = text.split()
    words = [w for w in words if r.random() > pick([0, 0, 0.1, 0.3])]
    if r.random() < 0.5:
        words[r.randrange(len(words) + 1) : 0] = prose(r, pick([1, 5, 20])).split()
    lines, at = [], 0
    while at < len(words):
        n = pick([6, 9, 200])
        lines.append(" ".join(words[at : at + n]))
        at += n
    mark = pick(["", "", "# ", "// ", " * ", "-- "])
    body = pick(["\n", "\r\n"]).join(mark + x for x in lines)
    body = {" * ": f"/*\n{body}\n */\n"}.get(mark, body)
    return pick(["", "", "#!/bin/sh\n", "\n\n"]) + body + pick(["", "\n\n" + prose(r, 3), "\n" + prose(r, 300), "\nint main"])


@pytest.mark.parametrize("seed", range(2))
def test_whole_operator(spark, seed):
    r = random.Random(seed)
    folder = lambda: "/".join(r.choice("abc") for _ in range(r.randrange(4)))
    files = [(f"{folder()}/f{i}".lstrip("/"), some_file(r) if r.random() < 0.4 else r.choice([None, "", prose(r, 30), "MIT"])) for i in range(150)]
    files += [(None, "x"), *r.sample(files, 5)] + [(p, "another text") for p, _ in r.sample(files, 3)]
    seen = compared(spark.createDataFrame(files, "path string, text string"), files)
    assert min(seen["own"], seen["inherited"]) > 10


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_documents(spark):
    df = licences.document_files(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).select("path", "text")
    assert compared(df, [tuple(x) for x in df.collect()])["own"] > 2
