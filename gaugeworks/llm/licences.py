"""Licence scans: sparse TF-IDF cosine of lines, leading comments and whole files to licence templates, then inheritance along directories.

In DataFrame operations only. Every word, a template's or not, weighs log((1 + N) / (1 + df)) + 1 with df over all
files. A line whose cosine reaches the threshold must hold one
of a template's heaviest terms, those without which the rest is too light, so only lines that do are
split into words; comments and files, only those that share enough of a template's weight. A file that is mostly licence lines is its directory's licence file; a file
without any takes the licence of the nearest directory above it that has such a file.
"""

from __future__ import annotations

from collections import Counter
from functools import cache
from importlib.resources import files as resources
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import keyed_join, small, stored, table

#: Short notices by which files name their licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Further single lines, titles and tags. Apart from TEMPLATES, which OP9_SQL is made of.
TITLES = {
    "Apache-2.0": ("Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-3-Clause": ("BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "GPL-3.0": ("GNU General Public License Version 3", "SPDX-License-Identifier: GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "MIT": ("MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"),
    # Told apart from the above, which they resemble.
    "BSD-2-Clause": ("BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"),
    "GPL-2.0": ("GNU General Public License Version 2", "SPDX-License-Identifier: GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"),
    "LGPL-2.1": ("GNU Lesser General Public License Version 2.1", "SPDX-License-Identifier: LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "LGPL-3.0": ("GNU Lesser General Public License Version 3", "SPDX-License-Identifier: LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"),
}
_GNU = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the
Free Software Foundation; either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License
for more details. You should have received a copy of the GNU {0}General Public License along with this program."""
_WEB, _POST = " If not, see <https://www.gnu.org/licenses/>.", " If not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
#: The usual header blocks of files.
HEADERS = {
    "Apache-2.0": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.""",
    ),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",),
    "CC-BY-4.0": ("This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",),
    "CC-BY-NC-4.0": ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",),
    "GPL-2.0": (_GNU.format("", 2) + _WEB, _GNU.format("", 2) + _POST),
    "GPL-3.0": (_GNU.format("", 3) + _WEB, _GNU.format("", 3) + _POST),
    "LGPL-2.1": (_GNU.format("Lesser ", "2.1") + _WEB, _GNU.format("Lesser ", "2.1") + _POST),
    "LGPL-3.0": (_GNU.format("Lesser ", 3) + _WEB,),
    "MIT": ("Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
}
THRESHOLD = 0.75
#: What is compared: a line (its number, from 0), the leading comment, the whole file.
LINE, BLOCK, WHOLE = 0, -1, -2
#: Most rows of directories, and of words, that are broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000
#: Words in more than this share of the files are broadcast always: no task gets all lines that hold one of them.
COMMON = 0.001


def terms(text: Column) -> Column:
    """Words of letters and digits of ASCII, in lower case, with repeats."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


@cache
def full_texts() -> dict[str, tuple[str, ...]]:
    """The licences' own texts, by name, without copyright lines; the Creative Commons' two are not among them."""
    return {f.name.removesuffix(".txt"): (f.read_text(encoding="utf-8"),) for f in sorted(resources(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name)}


def leading_comment(text: Column) -> Column:
    """The comment that a file begins with, after its first line if that is '#!': all of /* */, <!-- --> or triple quotes,
    or the lines begun by a comment's mark, blank ones between them included. '' if there is none."""
    bare = F.regexp_replace(text, r"^(#![^\n]*\n)?\s*", "")
    lines = F.split(bare, r"\r?\n")
    end = F.array_position(F.transform(lines, lambda x: x.rlike(r"^\s*(#|//|--|;|%|$)")), False)
    marked = F.array_join(F.when(end > 0, F.slice(lines, 1, F.greatest(end - 1, F.lit(0)))).otherwise(lines), "\n")
    closed = F.regexp_extract(bare, r"(?s)^(?:(?:/\*.*?\*/\s*)+|(?:<!--.*?-->\s*)+|\"{3}.*?\"{3}|'{3}.*?'{3})", 0)
    return F.when(bare.rlike(r"^(/\*|<!--|\"{3}|'{3})"), closed).otherwise(marked)


def _anchors(weights: dict, threshold: float, order: dict[str, float] | None = None) -> list[str]:
    """Terms of which every text holds one that reaches the threshold with any template; the greatest in ``order``, else in the template, first."""
    out = set()
    for vector in weights.values():
        total = sum(w * w for w in vector.values())
        rest = total
        for term, w in sorted(vector.items(), key=lambda x: (-(order[x[0]] if order else x[1]), x[0])):
            if rest < threshold**2 * total:
                break
            out.add(term)
            rest -= w * w
    return sorted(out)


def _one_a_path(base: DataFrame) -> DataFrame:
    """Rows (p, x) with the greatest x of each p; only the texts of repeated paths are shuffled."""
    again = stored(base.groupBy("p").count().filter("count > 1").select("p"), "licence-again")
    if not again.limit(1).count():
        return base
    again = small(again, BROADCAST_ROWS)
    greatest = stored(base.join(again, "p", "left_semi").groupBy("p").agg(F.max("x").alias("x")), "licence-greatest")
    return base.join(again, "p", "left_anti").unionByName(greatest)


def _weighed(counts: DataFrame, idf: DataFrame, least: float) -> DataFrame:
    """``counts`` with the idf (of all words) of its column w; a smaller idf than ``least`` is a common word's."""
    met = stored(idf.join(counts.select("w").distinct(), "w", "left_semi"), "licence-weights")
    if met.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return counts.join(F.broadcast(met), "w")
    common = F.broadcast(met.filter(F.col("idf") < least))
    return counts.join(common, "w").unionByName(counts.join(common, "w", "left_anti").join(met.filter(F.col("idf") >= least), "w").select(*counts.columns, "idf"))


def scan_licences(files: DataFrame, path: str = "path", text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD, mostly: float = 0.5, texts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per file: path, licence, cosine, lines (that reach the threshold), origin, licence_file.

    Lines are compared to ``templates`` (TEMPLATES and TITLES), whole files to ``texts`` (HEADERS and full_texts(); none if only templates are given),
    leading comments to texts and templates but TITLES.
    origin: 'own' (the best of the file's lines, its leading comment and the whole; equal cosines: the template first by name), 'inherited' (from licence_file, the nearest
    directory's; of several files in it the first by path) or 'none'. A file is a licence file if at least ``mostly`` of its words stand in lines,
    or in a leading comment or whole file, that reach the threshold. Directories end at '/'; the root is a directory too.

    Files are told apart by path: of rows with one path the greatest text counts. A null path is
    left out, a null or empty text has no lines. Whole texts are read.
    """
    if texts is None:
        texts = {n: HEADERS.get(n, ()) + full_texts().get(n, ()) for n in sorted({*HEADERS, *full_texts()})} if templates is None else {}
    titles = TITLES if templates is None else {}
    templates = TEMPLATES if templates is None else templates
    base = _one_a_path(files.filter(F.col(path).isNotNull()).select(F.col(path).alias("p"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x")))
    spark = files.sparkSession
    notices, named = list(templates.items()), [(n, t) for n, ts in texts.items() for t in ts]
    scopes = {LINE: notices + [(n, t) for n, ts in titles.items() for t in ts], BLOCK: notices + named, WHOLE: named}
    split = {(scope, i, name): Counter("".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()) for scope, ts in scopes.items() for i, (name, t) in enumerate(ts)}
    vocabulary = sorted({w for ws in split.values() for w in ws})
    total = base.count()
    frequency = stored(base.select(F.explode(F.array_distinct(terms(F.col("x")))).alias("w")).groupBy("w").agg(F.count("*").alias("df")), "licence-words")
    df = {r["w"]: r["df"] for r in frequency.filter(F.col("w").isin(vocabulary)).collect()}  # at most one row for each template term
    idf = {w: log((1 + total) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    weights = {key: {w: n * idf[w] for w, n in ws.items()} for key, ws in split.items()}
    of = lambda scope: {k: v for k, v in weights.items() if k[0] == scope}
    pattern = rf"(?i)(?<![a-z0-9])({'|'.join(_anchors(of(LINE), threshold))})(?![a-z0-9])"
    unit = [(*key, w, x / sum(y * y for y in v.values()) ** 0.5) for key, v in weights.items() for w, x in v.items()]
    template = spark.createDataFrame(unit, "scope int, id int, template string, w string, u double")
    known = frequency.select("w", (F.log((1 + total) / (1 + F.col("df"))) + 1).alias("idf"))

    lines = base.select("p", F.posexplode_outer(F.filter(F.split("x", r"\r?\n"), lambda x: x.rlike(pattern))).alias("line", "l")).filter("l is not null")
    units = lines.select("p", "line", "l")
    if named:
        # No comment or file reaches the threshold unless the terms that it shares make up threshold squared of a template.
        holds = lambda scope: F.arrays_overlap(terms(F.col("x")), F.array(*map(F.lit, _anchors(of(scope), threshold, idf))))
        likely = base.withColumn("b", leading_comment(F.col("x"))).filter(holds(WHOLE) | ((F.col("b") != "") & holds(BLOCK)))
        shared = likely.select("p", (F.col("b") != "").alias("b"), F.explode(F.array_distinct(terms(F.col("x")))).alias("w")).join(F.broadcast(template.filter(F.col("scope") != LINE)), "w").filter(F.col("b") | (F.col("scope") == WHOLE))
        enough = shared.groupBy("p", "scope", "id").agg(F.sum(F.col("u") * F.col("u")).alias("m")).filter(F.col("m") >= threshold**2 * (1 - 1e-6)).groupBy("p").agg(F.collect_set("scope").alias("scopes"))
        met = base.join(small(stored(enough, "licence-likely"), BROADCAST_ROWS), "p")
        both = F.array(F.struct(F.lit(BLOCK).alias("line"), leading_comment(F.col("x")).alias("l")), F.struct(F.lit(WHOLE).alias("line"), F.col("x").alias("l")))
        units = units.unionByName(met.select("p", F.inline(F.filter(both, lambda e: F.array_contains(F.col("scopes"), e["line"])))))
    counts = stored(units.select("p", "line", F.explode(terms(F.col("l"))).alias("w")).groupBy("p", "line", "w").agg(F.count("*").alias("tf")), "licence-counts")
    heavy = _weighed(counts, known, log(1 / COMMON) + 1).withColumn("x", F.col("tf") * F.col("idf"))
    size = heavy.groupBy("p", "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sum("tf").alias("words"))
    dots = heavy.withColumn("scope", F.least("line", F.lit(LINE))).join(F.broadcast(template), ["scope", "w"]).groupBy("p", "line", "id", "template").agg(F.sum(F.col("x") * F.col("u")).alias("dot"))
    cosine = dots.join(size, ["p", "line"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("cosine") >= threshold)
    best = cosine.groupBy("p", "line").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "template", "words")).alias("b"))
    in_lines, words = F.col("line") >= LINE, F.col("b.words")
    covered = F.greatest(F.sum(F.when(in_lines, words)), F.max(F.when(~in_lines, words)))
    own = stored(best.groupBy("p").agg(F.min(F.struct("b.c", "b.template")).alias("b"), F.count_if(in_lines).alias("lines"), covered.alias("words")).select("p", F.col("b.template").alias("licence"), (-F.col("b.c")).alias("cosine"), "lines", "words"), "licence-own")

    folder = lambda p: F.regexp_extract(p, "^(.*/)?", 0)
    # Only files with licence lines are split a second time, for the share of their words.
    whole = base.join(small(own.select("p", "licence", "words"), BROADCAST_ROWS), "p").filter(F.col("words") >= mostly * F.size(terms(F.col("x"))))
    folders = stored(whole.groupBy(folder(F.col("p")).alias("dir")).agg(F.min(F.struct(F.col("p").alias("licence_file"), F.col("licence").alias("given"))).alias("f")).select("dir", "f.licence_file", "f.given"), "licence-folders")

    paths = base.select("p").distinct()
    bare = paths.join(own.select("p"), "p", "left_anti")
    parts = F.split(folder(F.col("p")), "/")
    above = bare.select("p", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.when(i > 0, "/").otherwise("")).alias("dir")))).alias("d"))
    asked = above.select("p", "d.depth", "d.dir")
    if folders.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        given = asked.join(F.broadcast(folders), "dir")
    else:
        given = keyed_join(asked, folders, ["dir"], by=["p"])  # all files lie below the root
    taken = given.groupBy("p").agg(F.max(F.struct("depth", "licence_file", "given")).alias("g"))
    out = paths.join(own.drop("words"), "p", "left").join(taken, "p", "left")
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("g").isNotNull(), "inherited").otherwise("none")
    return out.select(F.col("p").alias(path), F.coalesce("licence", "g.given").alias("licence"), "cosine", F.coalesce("lines", F.lit(0)).alias("lines"), origin.alias("origin"), F.when(F.col("licence").isNull(), F.col("g.licence_file")).alias("licence_file"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files source/lang/doc_id; a null source or lang is '_'."""
    return docs.select(F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licences(document_files(table(spark, sf_dir, "documents").filter("doc_id is not null")))
    return out.select(F.regexp_extract("path", "[^/]*$", 0).cast("long").alias("doc_id"), "licence", F.round("cosine", 6).alias("cosine"), "lines", "origin", "licence_file")


_QUOTED = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES.items())
#: Documents stand two directories deep, so only source/lang/ can hold a licence file.
OP9_SQL = f"""
WITH tpl(template, t) AS (VALUES {_QUOTED}),
tt AS (SELECT template, w, count(*) AS tf FROM (SELECT template, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS w FROM tpl) GROUP BY ALL),
f AS (SELECT doc_id, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' AS dir, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || doc_id AS p, coalesce(text, '') AS x FROM documents WHERE doc_id IS NOT NULL),
n AS (SELECT count(*) AS n FROM f),
df AS (SELECT w, count(*) AS df FROM (SELECT DISTINCT p, unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) AS w FROM f) WHERE w IN (SELECT w FROM tt) GROUP BY 1),
v AS (SELECT w, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT w FROM tt) LEFT JOIN df USING (w), n),
tw AS (SELECT template, w, tf * idf AS y FROM tt JOIN v USING (w)), tn AS (SELECT template, sqrt(sum(y * y)) AS z FROM tw GROUP BY 1),
l AS (SELECT p, unnest(string_split(x, chr(10))) AS l, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM f),
c AS (SELECT p, i, w, count(*) AS tf FROM (SELECT p, i, unnest(regexp_extract_all(lower(l), '[a-z0-9]+')) AS w FROM l) GROUP BY ALL),
h AS (SELECT p, i, w, tf, tf * coalesce(idf, ln(1 + n) + 1) AS y FROM c LEFT JOIN v USING (w), n),
s AS (SELECT p, i, sqrt(sum(y * y)) AS norm, sum(tf) AS words FROM h GROUP BY 1, 2),
k AS (SELECT p, i, template, words, round(sum(h.y * tw.y / z) / norm, 9) AS cosine FROM h JOIN tw USING (w) JOIN tn USING (template) JOIN s USING (p, i) GROUP BY p, i, template, words, norm),
b AS (SELECT * FROM k WHERE cosine >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY p, i ORDER BY cosine DESC, template) = 1),
o AS (SELECT p, arg_min(template, (-cosine, template)) AS licence, max(cosine) AS cosine, count(*) AS lines, sum(words) AS words FROM b GROUP BY 1),
g AS (SELECT dir, min(p) AS licence_file, arg_min(licence, p) AS given FROM o JOIN f USING (p) WHERE words >= 0.5 * len(regexp_extract_all(lower(x), '[a-z0-9]+')) GROUP BY 1)
SELECT doc_id, coalesce(licence, given) AS licence, round(cosine, 6) AS cosine, coalesce(lines, 0) AS lines,
  CASE WHEN licence IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN licence IS NULL THEN licence_file END AS licence_file
FROM f LEFT JOIN o USING (p) LEFT JOIN g USING (dir)
"""
