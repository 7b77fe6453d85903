"""Quality, revisits, quotations, licences and the pipeline."""

import math
import os
import random
import re
import textwrap

import pytest
from plain import contamination, groups, linked_quotes, prose, words

from gaugeworks import storage
from gaugeworks.llm import common, ledger, licences, quality, quotes, warc

SF = "/root/testdata/sf0.01"


def corpus(spark):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        good = r.random() < 0.7
        text = " ".join(r.choice(["river", "stone", "walks", "under", "light", "of", "the"]) for _ in range(80)) if good else " ".join(r.choice(["BUY!!!", "$$$", "click", "click"]) for _ in range(60))
        toxic = int(good and r.random() < 0.3)
        docs.append((i, text + " vile" * toxic, "en" if i % 2 else None, "hot" if i % 3 else f"s{i}"))
        if i < 250:
            labels.append((i, int(good), toxic))
    truth = {i: (g, t) for i, g, t in labels}
    docs += [(1000, None, None, None), (1001, "", "en", "hot")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "'x' as accepted"), spark.createDataFrame([*labels, (5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int"), truth


def test_quality_held_out(spark):
    docs, labels, truth = corpus(spark)
    out = {r["doc_id"]: r for r in quality.quality(docs, labels.filter("doc_id < 150 or doc_id is null")).collect()}
    tried = [i for i in truth if i >= 150]
    assert len(out) == 402 and sum(out[i]["accepted"] == (truth[i] == (1, 0)) for i in tried) >= 0.95 * len(tried)
    assert all(0 <= r["p_good"] <= 1 and 0 < r["path_posterior"] < 1 for r in out.values())


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 0.0)] * 500 + [("big", "b", 1.0)] * 500 + [("one", "a", 0.0)] + [("rest", "a", 1.0)] * 1000
    got = {(r["__host"], r["__path"]): r for r in quality.site_posteriors(spark.createDataFrame(rows, "__host string, __path string, __good double"), "", "").collect()}
    assert got["one", "a"]["host_posterior"] > 0.3 > got["big", "a"]["path_posterior"] and got["big", "b"]["path_posterior"] > 0.9


def test_quality_without_labels_or_documents(spark):
    docs, labels, _ = corpus(spark)
    assert quality.quality(docs, labels.limit(0)).filter("accepted").count() == 402
    assert quality.quality(docs.limit(0), labels).collect() == []


def test_salted_join(spark, monkeypatch):
    docs, labels, _ = corpus(spark)
    told = quality.quality(docs, labels).select("doc_id", "p_good").collect()
    monkeypatch.setattr(quality, "BROADCAST_SITES", 0)
    assert sorted(map(str, quality.quality(docs, labels).select("doc_id", "p_good").collect())) == sorted(map(str, told))


@pytest.mark.parametrize("seed", [1, 2])
def test_revisits(spark, seed):
    r = random.Random(seed)
    urls = ["http://www.A.com:80/x/?b=2&a=1&utm_source=q#f", "https://a.com/x?a=1&b=2", "a.com/y", "http://hot.org", "https://hot.org/", None]
    records = []
    for i in range(300):
        full = r.random() < 0.5
        records.append((f"r{i:03}", r.choice(urls), r.choice([None, *range(0, 5000, 7)]), "response" if full else "revisit", r.choice([None, '"1"', 'W/"1"', '"2"']), r.choice([None, "mon", "tue"]), f"d{i}" if full else None, r.choice([None, {"Date": str(i), "Content-Type": "t"}])))
    records.append(records[-1])
    df = spark.createDataFrame(records, "record_id string, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    curl = dict(zip(urls, ["a.com/x?a=1&b=2", "a.com/x?a=1&b=2", "a.com/y", "hot.org", "hot.org", None]))
    expected = []
    for rid, url, ts, kind, etag, modified, _, headers in records:
        if kind == "revisit":
            before = [x for x in records if x[3] == "response" and url and ts is not None and x[2] is not None and curl[x[1]] == curl[url] and x[2] < ts]
            base = max(before, key=lambda x: (x[2], x[0]), default=None)
            strong = lambda e: e.removeprefix("W/")
            changed = base and (strong(etag) != strong(base[4]) if etag and base[4] else bool(modified and base[5] and modified != base[5]))
            outcome = "no response" if not base else "changed" if changed else "resolved"
            low = lambda m: {k.lower(): v for k, v in (m or {}).items()}
            merged = low(base[7]) | {k: v for k, v in low(headers).items() if k not in warc.FIXED_FIELDS} if outcome == "resolved" else None
            expected.append((rid, outcome, base and base[0], base[6] if outcome == "resolved" else None, merged and sorted(merged.items()) if merged is not None else None))
    out = [(x["record_id"], x["outcome"], x["source_record"], x["digest"], sorted(x["headers"].items()) if x["headers"] is not None else None) for x in warc.resolve_revisits(df).collect()]
    clean = lambda rows: sorted(map(str, [(a, b, c, d, e or ([] if e is not None else None)) for a, b, c, d, e in rows]))
    assert clean(out) == clean(expected)
    assert warc.resolve_revisits(df.limit(0)).collect() == []


def test_slices_follow_the_records(spark):
    """A stray timestamp doesn't put all others into one slice."""
    ts = [*range(1000, 6120), 10**15, -(10**15), None]
    rows = warc.sliced(spark.createDataFrame([(t,) for t in ts], "ts long")).collect()
    got = sorted((r["ts"], r["slice"]) for r in rows if r["ts"] is not None)
    slices = [s for _, s in got]
    assert slices == sorted(slices) and set(slices) == set(range(warc.SLICES)) and max(map(slices.count, set(slices))) < 60
    assert [r["slice"] for r in rows if r["ts"] is None] == [None]


def test_quotes(spark):
    rows = [
        ("t", 0, "Shall we meet?\nOn Monday?"), ("t", 1, "> Shall we  MEET?\n> On Monday?\nYes."), ("t", 2, ">> shall we meet?\n>> on monday?\n> Yes.\n\nFine, and lunch?"),
        ("t", 3, "> On Monday?\nNo, Tuesday."), ("t", 4, "> nobody said this\nhm"), ("t", 5, None), ("t", 6, "> > Yes.\n> Fine, and lunch?\nGladly"), ("u", 0, "> Yes.\nother thread"), ("u", None, "x"), ("t", 5, None),
    ]
    told, links = quotes.link_quotes(spark.createDataFrame(rows, "thread string, turn int, text string"))
    got = {(r["thread"], r["turn"]): (r["own"], r["parent"], r["root"], r["depth"]) for r in told.collect()}
    assert got == {
        ("t", 0): ("Shall we meet?\nOn Monday?", None, 0, 0), ("t", 1): ("Yes.", 0, 0, 1), ("t", 2): ("Fine, and lunch?", 1, 0, 2), ("t", 3): ("No, Tuesday.", 0, 0, 1),
        ("t", 4): ("hm", None, 4, 0), ("t", 5): ("", None, 5, 0), ("t", 6): ("Gladly", 2, 0, 3), ("u", 0): ("other thread", None, 0, 0),
    }
    assert sorted((r["turn"], r["passage"], r["level"], r["original"]) for r in links.collect()) == [(1, 0, 1, 0), (2, 0, 2, 0), (2, 1, 1, 1), (3, 0, 1, 0), (6, 0, 2, 1), (6, 1, 1, 2)]
    assert quotes.link_quotes(spark.createDataFrame([], "thread string, turn int, text string"))[0].collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_quotes_by_walking(spark, seed):
    """Random threads of quotes within quotes, some altered, some of nobody, some said twice."""
    r = random.Random(seed)
    rows = []
    for t in ("t", "u"):
        texts = []
        for o in range(40):
            lines = []
            for _ in range(r.choice([0, 1, 1, 2])):
                quoted = r.choice(texts) if texts else "none"
                some = quoted.split("\n")
                a = r.randrange(len(some))
                mark = r.choice(["> ", ">", ">> ", " > "])
                lines += [mark + (x.upper() if r.random() < 0.2 else x + r.choice(["", "", "  "])) for x in some[a : a + r.choice([1, 2, 9])]]
                lines += [r.choice(["", "I see", "> stray", "yes  indeed"])] * r.randrange(2)
            lines += [" ".join(r.choice(["fine", "no", "what", "then", "sun"]) for _ in range(r.choice([0, 1, 3, 5]))) for _ in range(r.randrange(3))]
            texts.append(r.choice(["\n", "\r\n"]).join(lines))
            rows.append((t, o, texts[-1] if o % 13 else None))
    told, links = quotes.link_quotes(spark.createDataFrame(rows, "thread string, turn int, text string"))
    out, expected = linked_quotes(rows)
    assert {(x["thread"], x["turn"]): (x["own"], x["parent"], x["root"], x["depth"]) for x in told.collect()} == out
    assert sorted((x["thread"], x["turn"], x["passage"], x["level"], x["original"]) for x in links.collect()) == expected and len(expected) > 30


def test_long_reply_chain(spark):
    rows = [("t", i, (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(70)]
    got = {r["turn"]: (r["root"], r["depth"]) for r in quotes.link_quotes(spark.createDataFrame(rows, "thread string, turn int, text string"))[0].collect()}
    assert got == {i: (0, i) for i in range(70)}


def cosines(files):
    terms = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    n = len(files)
    df = lambda w: sum(w in set(terms(t or "")) for _, t in files)
    vocabulary = {w for t in licences.TEMPLATES.values() for w in terms(t)}
    idf = {w: math.log((1 + n) / (1 + df(w))) + 1 for w in vocabulary}
    out = {}
    for path, text in files:
        best = None
        for line in (text or "").split("\n"):
            ws = terms(line)
            v = {w: ws.count(w) * idf.get(w, math.log(1 + n) + 1) for w in set(ws)}
            for name, t in licences.TEMPLATES.items():
                u = {w: terms(t).count(w) * idf[w] for w in terms(t)}
                c = sum(x * v.get(w, 0) for w, x in u.items())
                c = round(c / math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values())), 9) if v else 0
                if c >= licences.THRESHOLD:
                    best = min(best, (-c, name)) if best else (-c, name)
        out[path] = (best[1], round(-best[0], 6)) if best else (None, None)
    return out


def test_licences(spark):
    mit, gpl = licences.TEMPLATES["MIT"], licences.TEMPLATES["GPL-3.0"]
    files = [
        ("LICENSE", mit), ("a/x.c", "// code\n// " + gpl + "\n" + "more code here " * 20), ("a/y.c", "nothing"), ("a/b/COPYING", gpl + "\n"), ("a/b/c/z.c", None), ("a/b/c/d/w.c", "int main"),
        ("q/only", "Released under the license of MIT today"), ("q/apache.txt", "Licensed under the Apache License"), ("q/" + "long", "word " * 500 + mit), (None, mit),
    ]
    got = {r["path"]: r for r in licences.scan_licences(spark.createDataFrame(files, "path string, text string")).collect()}
    plain = cosines([f for f in files if f[0] is not None])
    for path, (licence, cosine) in plain.items():
        r = got[path]
        assert (r["licence"], round(r["cosine"], 6)) == (licence, cosine) if licence else r["origin"] != "own", path
    assert (got["a/b/c/d/w.c"]["licence"], got["a/b/c/d/w.c"]["licence_file"], got["a/y.c"]["licence"]) == ("GPL-3.0", "a/b/COPYING", "MIT")
    assert got["a/x.c"]["origin"] == "own" and len(got) == 9
    assert licences.scan_licences(spark.createDataFrame([], "path string, text string")).collect() == []


NOTICE = "This project is released under the MIT License."


@pytest.mark.parametrize("most", [licences.BROADCAST_ROWS, 0])
def test_licence_words_weigh_by_all_files(spark, monkeypatch, most):
    """Ordinary words beside a notice's weigh little however many files there are."""
    monkeypatch.setattr(licences, "BROADCAST_ROWS", most)
    files = [(f"n/{i}", NOTICE) for i in range(2)] + [(f"d/{i}", f"this project is number {i}") for i in range(3000)]
    got = {r["path"]: r for r in licences.scan_licences(spark.createDataFrame(files, "path string, text string")).collect()}
    df = {"this": 3002, "project": 3002, "is": 3002, **dict.fromkeys(["released", "under", "the", "mit", "license"], 2)}
    w = {k: (math.log(3003 / (1 + v)) + 1) ** 2 for k, v in df.items()}
    expected = math.sqrt(sum(w[k] for k in ("released", "under", "the", "mit", "license")) / sum(w.values()))
    assert got["n/0"]["licence"] == "MIT" and abs(got["n/0"]["cosine"] - expected) < 1e-6
    assert got["d/7"]["origin"] == "none"


def test_licences_of_repeated_paths(spark):
    mit, gpl = licences.TEMPLATES["MIT"], licences.TEMPLATES["GPL-3.0"]
    quarter = mit + "\n" + " ".join(f"w{i}" for i in range(15))
    files = [("a/x", quarter), ("a/x", quarter), ("a/x", quarter), ("a/bare", "nothing"), ("b/y", gpl), ("b/y", "zebra " * 30), ("c/y", "AARDVARK " * 30), ("c/y", gpl), ("c/y", None)]
    once = [("a/x", quarter), ("a/bare", "nothing"), ("b/y", "zebra " * 30), ("c/y", gpl)]
    got, want = (sorted(map(str, licences.scan_licences(spark.createDataFrame(f, "path string, text string")).collect())) for f in (files, once))
    assert got == want and len(got) == 4 and "origin='none'" in got[0] and "licence='GPL-3.0'" in got[3]


def test_licence_texts_and_headers(spark):
    """Licence files as they are found, wrapped headers, tags and titles."""
    own = "Copyright (c) 2021 Jane Doe and others. All rights reserved.\n\n"
    wrap = lambda t, mark, n: "\n".join(mark + x for x in textwrap.wrap(t, n))
    code = "\n\nint main(void) { return call(17); }\n" * 30
    head = {n: t[0] for n, t in licences.HEADERS.items()}
    files = {f"full/{n}/LICENSE": (n, own + textwrap.fill(t[0], 61)) for n, t in licences.full_texts().items()} | {
        "h/a.py": ("Apache-2.0", "#!/usr/bin/env python\n" + wrap(own + head["Apache-2.0"], "# ", 50) + code), "h/g.c": ("GPL-3.0", "/*\n" + wrap(own + head["GPL-3.0"], " * ", 44) + "\n */" + code),
        "h/m.js": ("MPL-2.0", wrap(head["MPL-2.0"], "// ", 40) + code), "h/l.html": ("LGPL-2.1", "<!--\n" + wrap(own + head["LGPL-2.1"], "", 70) + "-->" + code), "h/n.sh": ("GPL-3.0", wrap(licences.TEMPLATES["GPL-3.0"], "# ", 30) + code),
        "s/a.c": ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0" + code), "s/m": ("MIT", "MIT License\n" + code), "n/none.c": (None, "// a program that calls 17" + code), "n/none": (None, "the software is provided by the copyright holders " + code),
        "full/MIT/src/x.c": ("MIT", code),
    }
    got = {r["path"]: r for r in licences.scan_licences(spark.createDataFrame([(p, t) for p, (_, t) in files.items()], "path string, text string")).collect()}
    assert {p: r["licence"] for p, r in got.items()} == {p: n for p, (n, _) in files.items()}
    assert got["full/MIT/src/x.c"]["licence_file"] == "full/MIT/LICENSE" and got["h/g.c"]["origin"] == "own"


def contaminated(text, bench):
    """Whether the text holds a window of an item, as texts between marks."""
    ws = words(text)
    return any(tuple(ws[i : i + n]) in windows for n, windows in bench[1].items() for i in range(len(ws) - n + 1))


def windows_of(bench):
    out = {}
    for item, t in bench:
        ws = words(t)
        n = min(10, len(ws))
        if item is not None and n:
            out.setdefault(n, set()).update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    return bench, out


def test_stages_of_odd_rows(spark, tmp_path):
    """Null, empty, long and repeated texts, null ids, columns with the operators' own names, and no rows at all."""
    import corpus_pipeline as p

    r = random.Random(4)
    long_ = prose(r, 30_000, 10**6)
    passage = prose(r, 12, 10**6)
    rows = [(0, None), (1, ""), (2, long_), (3, long_ + " end"), (None, passage), (None, "fine words of no harm"), (4, "token=abcdefgh"), (4, prose(r, 40)), (5, " \t"), (6, passage.upper()), (2, long_)]
    docs = spark.createDataFrame([(d, t, "en", None, 0, "mine", "mine", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, blob string, e_good string, cid int")
    spark.createDataFrame([(0, passage), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        seen[name] = sorted(((x["doc_id"], x["text"]) for x in out.collect()), key=str)
        assert all((x["blob"], x["e_good"], x["cid"]) == ("mine", "mine", 1) for x in out.collect())
    key = lambda some: sorted(some, key=str)
    assert seen["quality classifier"] == key(rows)
    kept = seen["n-gram Jaccard join"]
    assert {d for d, _ in kept} == {0, 1, 2, 4, 5, 6, None} and len(kept) == 8
    assert seen["benchmark decontamination"] == key([x for x in rows if (x[1] or "").lower() != passage])
    masked = seen["secret scans"]
    assert (4, "[SECRET]") in masked and len(masked) == len(rows) and key([x for x in masked if x[1] != "[SECRET]"]) == key([x for x in rows if x[1] != "token=abcdefgh"])
    pieces = p.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(x["length"] == x["doc_tokens"] == 1 for x in pieces) == 2 and p.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).collect() == []


def test_extra_columns(spark):
    """Columns with names that the operators use themselves change nothing."""
    from gaugeworks.llm import decontaminate

    extra = lambda df: df.selectExpr("*", *(f"'mine' as {c}" for c in ("curl", "slice", "own", "th_", "ws_", "seeds", "t", "o", "x", "p", "w", "line", "l_", "near", "hash", "window") if c not in df.columns))
    show = lambda df, *columns: sorted(map(str, df.select(*columns).collect()))
    docs, bench = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "q")], "doc_id long, text string"), spark.createDataFrame([(1, "b c d e f g h i j k")], "item_id long, text string")
    assert show(decontaminate.decontaminate(extra(docs), extra(bench)), "*") == show(decontaminate.decontaminate(docs, bench), "*")
    records = spark.createDataFrame([("r", "a.com", 1, "response", "e", None, "d", {"Date": "1", "date": "2", "X": "y"}), ("v", "a.com", 2, "revisit", "e", None, None, {"date": "3", "DATE": "4"})], "record_id string, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    told = warc.resolve_revisits(extra(records))
    assert show(told, "*") == show(warc.resolve_revisits(records), "*") and told.first()["headers"] == {"x": "y", "date": "3"}
    mails = spark.createDataFrame([("t", 0, "hello there\n" * 5000), ("t", 1, "> hello there\nyes")], "thread string, turn int, text string")
    assert show(quotes.link_quotes(extra(mails))[0], "*") == show(quotes.link_quotes(mails)[0], "*")
    files = spark.createDataFrame([("a/LICENSE", licences.TEMPLATES["MIT"]), ("a/x", "word " * 50_000)], "path string, text string")
    assert show(licences.scan_licences(extra(files)), "*") == show(licences.scan_licences(files), "*")


def test_hot_records(spark, monkeypatch):
    """One URL at one instant, and one root that all answer, dealt to several tasks."""
    monkeypatch.setattr(storage, "HOT_LEAST", 3)
    records = [(f"r{i:03}", "a.com", 5 + i % 2, "response", None, None, f"d{i}", {}) for i in range(40)] + [(f"v{i}", "a.com", 7 if i % 4 else 6, "revisit", None, None, None, {}) for i in range(60)]
    df = spark.createDataFrame(records, "record_id string, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    assert {(x["ts"], x["source_record"]) for x in warc.resolve_revisits(df).collect()} == {(6, "r038"), (7, "r039")} and warc.resolve_revisits(df).count() == 60
    rows = [("t", 0, "all of this")] + [("t", i, f"> all of this\nanswer {i}") for i in range(1, 80)]
    told = quotes.link_quotes(spark.createDataFrame(rows, "thread string, turn int, text string"))[0].collect()
    assert {(x["root"], x["depth"], x["parent"]) for x in told if x["turn"]} == {(0, 1, 0)} and len(told) == 80


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.limit(0).selectExpr("*", "1 as Accepted", "'b' as blob")
    frames = [docs]
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, wide, SF).columns == wide.columns
        frames.append(stage(spark, frames[-1], SF).cache())
        assert frames[-1].columns == docs.columns
    rows = [[(r["doc_id"], r["text"]) for r in f.select("doc_id", "text").orderBy("doc_id").collect()] for f in frames]
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {d for d, _ in rows[1]}
    clean = [d for d, x in labels.items() if x == (1, 0)]
    assert sum(d in kept for d in clean) >= 0.98 * len(clean) and sum(d in kept for d, x in labels.items() if x[0] == 0) <= 0.1 * sum(x[0] == 0 for x in labels.values())
    component, _ = groups(rows[1], 5, 80, 100)
    assert rows[2] == [x for x, c in zip(rows[1], component) if x[0] == c]
    bench = windows_of([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert rows[3] == [x for x in rows[2] if not contaminated(x[1], bench)] and len(rows[3]) < len(rows[2])
    masked = dict(rows[4])
    assert len(masked) == len(rows[3]) and all(("[SECRET]" in masked[d]) == bool(ledger.find_secrets(t)) for d, t in rows[3])
    pieces = p.STAGES[-1][1](spark, frames[4], SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == set(masked)


def test_pipeline_decisions(spark, tmp_path):
    """Decontamination drops exactly what brute force finds, and the classifier toxic documents."""
    import corpus_pipeline as p

    r = random.Random(4)
    bench = [(i, prose(r, r.choice([5, 10, 14, 30]), 10**5)) for i in range(12)]
    docs = []
    for i in range(60):
        taken = r.choice(bench)[1].split()
        docs.append((i, " ".join([prose(r, 15, 10**5), *(taken if i % 3 == 0 else taken[:4] if i % 3 == 1 else []), prose(r, 15, 10**5)])))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = sorted(tuple(x) for x in p.clean(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path)).collect())
    expected = [x for x in docs if not contamination(x[1], bench)[1]]
    assert kept == expected and len(expected) == 40

    texts, labels, truth = corpus(spark)
    labels.filter("doc_id < 150").write.parquet(f"{tmp_path}/labels.parquet")
    ids = {x["doc_id"] for x in p.good(spark, texts, str(tmp_path)).select("doc_id").collect()}
    toxic = [i for i, x in truth.items() if i >= 150 and x[1]]
    assert toxic and sum(i in ids for i in toxic) <= 0.05 * len(toxic)
