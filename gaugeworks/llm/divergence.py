"""Source divergence audit: how each source's use of words departs from that of the others of its language.

Tasks find terms and count them with arrays. Counts are dealt to shards by a hash of language and term; a shard
holds all there is to know of its terms, so it tells which are kept and makes its part of every sum over
terms. Counts travel as blocks, many to a row, with their terms and groups once each. Spark adds the parts up and ranks. All numbers are whole.

A pair's sum runs over all kept terms, most of which a source doesn't hold. With f(c, d) the value where one source counts c
and the other d, the sum is made of three kinds of parts, none of which looks at a term that neither holds:
f(0, 0) for every kept term; f(c, 0) - f(0, 0) and f(0, d) - f(0, 0) by how many terms a source counts c times; and for each term that
both hold f(c, d) - f(c, 0) - f(0, d) + f(0, 0).
"""

from __future__ import annotations

import re
import shutil
import tempfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import keyed_join, slices, small, stored, table, text_bytes

#: Documents of a language that a kept term stands in, least; whole number that a share of 1 is; most terms reported of a group.
DOCUMENTS, UNIT, RANKS = 3, 1_000_000_000, 200
#: Bytes of text that a task counts at a time, and characters after which a longer text is cut between terms.
PART_BYTES, CUT_CHARS = 6_000_000, 1_000_000
#: Characters of text whose terms are found at a time: small enough to stay in a core's cache.
FIND_CHARS = 400_000
#: Rows of counts after which a task passes on what it has.
HELD_ROWS = 1_500_000
#: Bytes of text whose counts make a shard, about.
SHARD_BYTES = 12_000_000
#: Most groups that are broadcast to the counts; beyond it they are joined by shuffling.
BROADCAST_GROUPS = 200_000
#: What a task's DuckDB may take of memory before it goes to the task's own disk.
DUCK_MEMORY = "200MB"
#: The bytes of UTF-8 that terms are made of: of what is no letter only ASCII is left out.
_LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_OTHERS = bytes(np.flatnonzero(~_LETTER).tolist())
_LOWER = bytes(range(256)).lower()
_BETWEEN = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")


class Duck:
    """A DuckDB of one task, on one thread, with a folder of its own that goes with it."""

    def __enter__(self) -> duckdb.DuckDBPyConnection:
        self.folder = tempfile.mkdtemp(prefix="duck-")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DUCK_MEMORY, "temp_directory": self.folder, "preserve_insertion_order": False})
        return self.db

    def __exit__(self, *_) -> None:
        self.db.close()
        shutil.rmtree(self.folder, ignore_errors=True)


def _batches(db: duckdb.DuckDBPyConnection, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in db.sql(sql).to_arrow_reader(100_000):
        yield from pa.Table.from_batches([batch]).cast(schema).to_batches()


def _cut(text: str) -> Iterator[str]:
    """A text as pieces that no term crosses; a term longer than a piece stays whole."""
    at = 0
    while len(text) - at > CUT_CHARS:
        m = _BETWEEN.search(text, at + CUT_CHARS)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Counts(NamedTuple):
    """Counts by term and group: n occurrences in docs rows. term and group are places in terms and groups (lang, source)."""

    terms: pa.Array
    groups: list[tuple[str, str]]
    term: np.ndarray
    group: np.ndarray
    n: np.ndarray
    docs: np.ndarray


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where in sorted rows a new value of the keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _order(key: np.ndarray) -> np.ndarray:
    """The order that sorts whole numbers of 0 and more. Sorting them with their places below is several times faster than argsort."""
    bits = len(key).bit_length()
    if not len(key) or int(key.max()) >> 63 - bits:
        return np.argsort(key, kind="stable")
    key = key << bits | np.arange(len(key))
    key.sort()
    return key & (1 << bits) - 1


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begins) if len(begins) else values[:0]


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in their order, lower-cased, and how many each text has."""
    raw, at = text_bytes(texts)
    letter = _LETTER[raw]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    heads = at[:-1][at[:-1] < len(raw)]
    begins[heads] = letter[heads]  # no term crosses into the next text
    begins = np.flatnonzero(begins)
    before = np.cumsum(letter, dtype=np.int64)
    ends = np.append(before[begins] - 1, before[-1] if len(before) else 0)
    data = pa.py_buffer(raw.tobytes().translate(_LOWER, _OTHERS))
    terms = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(ends), data)
    return terms, np.diff(np.searchsorted(begins, at))


def _counted(langs: list[str], sources: list[str], texts: list[str]) -> Counts:
    """The counts of some rows."""
    rows, pieces = [], []
    for i, text in enumerate(texts):
        for piece in _cut(text):
            rows.append(i)
            pieces.append(piece)
    found, row = [], []
    for low, high in slices(map(len, pieces), FIND_CHARS):
        terms, many = _terms(pa.array(pieces[low:high], pa.large_string()))
        found.append(terms)
        row.append(np.repeat(np.array(rows[low:high], np.int64), many))
    coded = pa.concat_arrays(found).dictionary_encode()
    groups = sorted(set(zip(langs, sources)))
    place = {g: i for i, g in enumerate(groups)}
    group = np.array([place[g] for g in zip(langs, sources)], np.int64)
    order = _order(group)  # rows of one group side by side
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    bits = max(1, len(order).bit_length())
    key = coded.indices.to_numpy().astype(np.int64) << bits | rank[np.concatenate(row)]
    key.sort()
    at = _runs(key)
    n = np.diff(at, append=len(key))
    term, group = key[at] >> bits, group[order][key[at] & (1 << bits) - 1]
    at = _runs(term, group)
    return Counts(coded.dictionary, groups, term[at], group[at], _sums(n, at), np.diff(at, append=len(n)))


def _merged(parts: list[Counts]) -> Counts:
    """The sum of all parts, sorted by term and group; groups sorted."""
    coded = pa.concat_arrays([p.terms for p in parts]).dictionary_encode()
    groups = sorted({g for p in parts for g in p.groups})
    place = {g: i for i, g in enumerate(groups)}
    codes, first = coded.indices.to_numpy(), np.cumsum([0, *(len(p.terms) for p in parts)])
    bits = max(1, len(groups).bit_length())
    key = np.concatenate([codes[p.term + at].astype(np.int64) << bits | np.array([place[g] for g in p.groups], np.int64)[p.group] for p, at in zip(parts, first)])
    order = _order(key)
    key = key[order]
    at = _runs(key)
    n, docs = (_sums(np.concatenate([getattr(p, c) for p in parts])[order], at) for c in ("n", "docs"))
    return Counts(coded.dictionary, groups, key[at] >> bits, key[at] & (1 << bits) - 1, n, docs)


def _block(c: Counts, rows: np.ndarray) -> bytes:
    """Some rows of counts, with the terms and groups that they name, as Arrow's bytes."""
    terms, term = np.unique(c.term[rows], return_inverse=True)
    groups, group = np.unique(c.group[rows], return_inverse=True)
    named = [c.groups[g] for g in groups]
    sink = pa.BufferOutputStream()
    named = pa.record_batch({"lang": pa.array([g[0] for g in named], pa.string()), "source": pa.array([g[1] for g in named], pa.string())})
    counts = pa.record_batch({"term": term.astype(np.int32), "group": group.astype(np.int32), "n": c.n[rows], "docs": c.docs[rows]})
    for batch in (pa.record_batch({"term": c.terms.take(pa.array(terms))}), named, counts):
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unblocked(block: bytes) -> Counts:
    source = pa.BufferReader(block)
    terms, groups, counts = (pa.ipc.open_stream(source).read_all().to_batches()[0] for _ in range(3))
    return Counts(terms["term"], list(zip(groups["lang"].to_pylist(), groups["source"].to_pylist())), *(counts[c].to_numpy() for c in ("term", "group", "n", "docs")))


def term_counts(docs: DataFrame, shards: int) -> DataFrame:
    """shard and block: counts of terms by language and source, as parts to be added up. docs: lang, source, text."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.binary())])

    def passed(parts: list[Counts]) -> Iterator[pa.RecordBatch]:
        c = _merged(parts)
        of_term = np.array([zlib.crc32(t) for t in c.terms.cast(pa.large_binary()).to_pylist()], np.int64)
        of_lang = np.array([zlib.crc32(g[0].encode()) for g in c.groups], np.int64)
        shard = (of_term[c.term] + 31 * of_lang[c.group]) % shards
        order = _order(shard)
        at = _runs(shard[order])
        for low, high in zip(at, [*at[1:], len(order)]):
            yield pa.record_batch([pa.array([shard[order[low]]], pa.int32()), pa.array([_block(c, order[low:high])], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Counts] = []
        for batch in batches:
            for low, high in slices(pc.binary_length(batch.column(2)).to_pylist(), PART_BYTES):
                parts.append(_counted(*(c.to_pylist() for c in batch.slice(low, high - low).columns)))
                if sum(len(p.n) for p in parts) > HELD_ROWS:
                    yield from passed(parts)
                    parts = []
        if parts:
            yield from passed(parts)

    return docs.mapInArrow(run, "shard int, block binary")


def kept_counts(parts: DataFrame, shards: int, documents: int) -> DataFrame:
    """Counts of the kept terms, as blocks that have all of their terms, each with a shard; and without a block, by shard, lang and source,
    how many kept terms are counted n times (terms), or, without a source, how many a language has."""
    wanted = pa.schema([("shard", pa.int32()), ("block", pa.binary()), ("lang", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("terms", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], []
        for batch in batches:
            shard += batch.column(0).to_pylist()
            held += [_unblocked(b) for b in batch.column(1).to_pylist()]
        if not held:
            return
        c = _merged(held)
        langs = {name: i for i, name in enumerate(sorted({g[0] for g in c.groups}))}
        lang = np.array([langs[g[0]] for g in c.groups], np.int64)[c.group]
        at = _runs(c.term, lang)
        enough = _sums(c.docs, at) >= documents
        rows = np.flatnonzero(np.repeat(enough, np.diff(at, append=len(lang))))
        own = min(shard)
        many = np.bincount(lang[at[enough]], minlength=len(langs))
        order = rows[np.lexsort((c.n[rows], c.group[rows]))]
        bar = _runs(c.group[order], c.n[order])
        told = [(own, _block(c, rows), None, None, None, None)] if len(rows) else []
        told += [(own, None, name, None, 0, int(v)) for name, v in zip(langs, many) if v]
        told += [(own, None, *c.groups[g], n, terms) for g, n, terms in zip(c.group[order][bar].tolist(), c.n[order][bar].tolist(), np.diff(bar, append=len(order)).tolist())]
        if told:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*told), wanted)], schema=wanted)

    return parts.repartition(shards, "shard").mapInArrow(run, "shard int, block binary, lang string, source string, n long, terms long")


def parts_of_sums(kept: DataFrame, sums: DataFrame, shards: int, ranks: int) -> DataFrame:
    """By shard, each source's most outstanding terms, and what the terms that two sources both hold add to the value of the two.

    kept: shard and block. sums: shard, lang, source, total, v and lang_total of all groups in the shard's block.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = "lang string, source string, part string, item string, value decimal(38,0)"
    wanted = pa.schema([(f.name, f.type) for f in to_arrow_schema(StructType.fromDDL(schema))])
    result = f"""WITH l AS (SELECT t, l, {_share('sum(n)', 'any_value(lang_total)', 'any_value(v)')} AS q FROM c GROUP BY ALL),
          f AS (SELECT g, t, {_value('p', 'q')} AS value FROM c JOIN l USING (t, l) WHERE p > q),
          best AS (SELECT g, term, value FROM f JOIN terms USING (t) QUALIFY row_number() OVER (PARTITION BY g ORDER BY value DESC, term) <= {ranks}),
          pair AS (SELECT a.g AS g, b.g AS h, sum({_value('a.p', 'b.p')} - {_value('a.p', 'b.p0')} - {_value('a.p0', 'b.p')} + {_value('a.p0', 'b.p0')}) AS value
            FROM c AS a JOIN c AS b ON a.t = b.t AND a.l = b.l AND a.g <> b.g GROUP BY ALL)
        SELECT lang, source, 'term' AS part, term AS item, value FROM best JOIN groups USING (g)
        UNION ALL
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, value FROM pair JOIN groups AS a ON a.g = pair.g JOIN groups AS b ON b.g = pair.h"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = [], {}
        for batch in batches:
            _, blocks, *columns = (c.to_pylist() for c in batch.columns)
            held += [_unblocked(b) for b in blocks if b is not None]
            known |= {(lang, source): rest for b, lang, source, *rest in zip(blocks, *columns) if b is None}
        if not held:
            return
        c = _merged(held)
        total, v, lang_total = (pa.array([known[g][i] for g in c.groups], pa.int64()) for i in range(3))
        langs = {name: i for i, name in enumerate(sorted({g[0] for g in c.groups}))}
        groups = pa.table({"g": pa.array(range(len(c.groups)), pa.int32()), "l": pa.array([langs[g[0]] for g in c.groups], pa.int32()), "lang": pa.array([g[0] for g in c.groups], pa.string()), "source": pa.array([g[1] for g in c.groups], pa.string()), "total": total, "v": v, "lang_total": lang_total})
        with Duck() as db:
            db.register("groups", groups)
            db.register("terms", pa.table({"t": pa.array(np.arange(len(c.terms), dtype=np.int32)), "term": c.terms}))
            db.register("part", pa.table({"t": c.term.astype(np.int32), "g": c.group.astype(np.int32), "n": c.n}))
            db.execute(f"""CREATE TABLE c AS SELECT t, g, l, n, {_share('n', 'total', 'v')} AS p, {_share('0', 'total', 'v')} AS p0, v, lang_total::HUGEINT AS lang_total FROM part JOIN groups USING (g)""")
            yield from _batches(db, result, wanted)

    sums = sums.select("shard", F.lit(None).cast("binary").alias("block"), "lang", "source", "total", "v", "lang_total")
    return kept.unionByName(sums, allowMissingColumns=True).repartition(shards, "shard").mapInArrow(run, schema)


def _share(count: str, total: str, v: str) -> str:
    """The share of a count, in parts of UNIT, at least 1 and at most UNIT + 1. Made of whole numbers of 128 bits, it has 64, as has a value: at most UNIT**2."""
    return f"CAST(1 + ({UNIT}::HUGEINT * ({count} + 1)) // ({total} + {v}) AS BIGINT)"


def _value(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) // ({q}))"


def divergence(docs: DataFrame, documents: int = DOCUMENTS, ranks: int = RANKS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: for each source of each language, the other sources by how far its shares of
    the language's kept terms lie from theirs (part "pair", all ranks), and its own most outstanding terms (part "term", up to ``ranks``).

    A term is a run of letters (A-Z lower-cased, and all beyond ASCII); a language keeps those that at least ``documents`` of
    its rows hold. Null text, language and source are empty strings; texts without terms count as documents of their source. A share
    is 1 + floor(10**9 (count + 1) / (N + V)), V being the number of kept terms and N the count of them all; a value
    floor((p - q)**2 / q). Of equal values the item whose UTF-8 is smaller comes first. Repeated rows count each; an empty table gives no rows. Whole
    texts are counted, over all rows; other columns are not looked at.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).alias("text"))
    # As many shards as the texts' bytes ask for.
    groups = stored(base.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes")), "divergence-sources")
    shards = max(1, -(-(groups.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES))

    # Kept terms: a shard has every part of its terms.
    told = stored(kept_counts(term_counts(base, shards), shards, documents), "divergence-kept")
    blocks, bars = told.filter("block is not null").select("shard", "block"), told.filter("source is not null")
    mine = bars.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("total"), F.sum("terms").alias("held"))
    terms = told.filter("block is null").groupBy("lang").agg(F.sum(F.when(F.col("source").isNull(), F.col("terms"))).alias("v"), F.sum(F.when(F.col("source").isNotNull(), F.col("n") * F.col("terms"))).alias("lang_total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    groups = groups.join(mine, ["lang", "source"], "left").join(terms, "lang", "left").select("lang", "source", zero("total"), zero("held"), zero("v"), zero("lang_total"))
    groups = stored(groups, "divergence-groups")

    # Every shard knows the sums of its groups and their languages.
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    sums, there = groups.select("lang", "source", "total", "v", "lang_total"), bars.select("shard", "lang", "source").distinct()
    known = there.join(F.broadcast(sums), ["lang", "source"]) if few else keyed_join(there, sums, ["lang", "source"], by=["shard"])
    told = stored(parts_of_sums(blocks, known, shards, ranks), "divergence-shards")  # a few hundred rows for each group and shard
    top = told.filter("part = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"))
    both = told.filter("part = 'pair'").drop("part")

    # How many terms a group counts n times: a few rows for each group.
    bars = bars.groupBy("lang", "source", "n").agg(F.sum("terms").alias("terms"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("other_total"), F.col("held").alias("other_held"))
    share = lambda count, total: F.lit(1).cast("decimal(38,0)") + F.call_function("div", F.lit(UNIT).cast("decimal(20,0)") * (count.cast("decimal(18,0)") + 1), (total + F.col("v")).cast("decimal(38,0)"))
    value = lambda p, q: F.call_function("div", (p - q).cast("decimal(19,0)") * (p - q).cast("decimal(19,0)"), q.cast("decimal(19,0)")).cast("decimal(38,0)")
    none = F.lit(0)
    paired = groups.join(small(other, BROADCAST_GROUPS), "lang").filter("source <> item")
    at_zero = value(share(none, F.col("total")), share(none, F.col("other_total")))
    rest = paired.select("lang", "source", "item", (F.when(F.col("v") > 0, at_zero * F.col("v")).otherwise(0)).cast("decimal(38,0)").alias("value"))
    # A source's own bars against all others without the term, and the others' bars against it: each of the two from the side that holds it.
    met = bars.join(small(groups.select("lang", "source", "total", "v"), BROADCAST_GROUPS), ["lang", "source"]).join(small(other, BROADCAST_GROUPS), "lang").filter("source <> item")
    mine_, theirs = share(F.col("n"), F.col("total")), share(none, F.col("other_total"))
    base_here, base_there = share(none, F.col("total")), share(none, F.col("other_total"))
    here = met.select("lang", "source", "item", ((value(mine_, theirs) - value(base_here, base_there)) * F.col("terms")).cast("decimal(38,0)").alias("value"))
    there = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), ((value(theirs, mine_) - value(base_there, base_here)) * F.col("terms")).cast("decimal(38,0)").alias("value"))
    pair = both.unionByName(rest).unionByName(here).unionByName(there).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    out = pair.withColumn("part", F.lit("pair")).unionByName(top.withColumn("part", F.lit("term")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = out.withColumn("rank", rank.cast("int")).filter((F.col("part") == "pair") | (F.col("rank") <= ranks))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source FROM d GROUP BY ALL),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.total + v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (v.total + v.v) AS q
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term JOIN s ON s.lang = g.lang AND s.source = g.source JOIN v ON v.lang = g.lang),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM y UNION ALL SELECT * FROM z)) WHERE part = 'pair' OR rank <= 200
"""
