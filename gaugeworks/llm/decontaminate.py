"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text is a sequence of words. Of the k-gram hashes in each window of ``span`` words only the
smallest is kept; windows in a row that keep the same value are one seed. Two texts that share
``span`` words in a row share that value, so joining seeds finds every shared span. Seeds that
meet are extended to the whole windows around them, and these are compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import stored, table

SPAN, KGRAM = 10, 5
#: Most rows of seeds or windows that are broadcast; beyond it both sides are shuffled, the benchmark's in so many copies,
#: so that a passage that most documents hold isn't one task's.
BROADCAST_ROWS, COPIES = 1_000_000, 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words once A-Z are lower case, and what words are made of before that.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """The words of a text column, in order; null has none."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _at(array: str, i: int) -> str:
    return f"{array}[i + {i}]" if i else f"{array}[i]"


def _winnowed(rows: DataFrame, span: int, keep: list[str]) -> DataFrame:
    """keep and seeds: array of (fp, lo, hi), windows lo to hi having fp as least hash; rows has words ws_.

    Each step is a column of its own that the next one reads several times, so that the
    optimiser doesn't repeat its work inside the next one's loop.
    """
    k = min(KGRAM, span)
    w = span - k + 1
    up_to = lambda array, cut: f"if(size({array}) >= {cut + 1}, sequence(0, size({array}) - {cut + 1}), cast(array() as array<int>))"
    gram = f"xxhash64({', '.join(_at('h_', i) for i in range(k))})"
    least = f"least({', '.join(_at('g_', i) for i in range(w))})" if w > 1 else "g_[i]"
    out = rows.select(*keep, F.expr("transform(ws_, x -> xxhash64(x)) as h_"))
    out = out.select(*keep, F.expr(f"transform({up_to('h_', k - 1)}, i -> {gram}) as g_"))
    out = out.select(*keep, F.expr(f"transform({up_to('g_', w - 1)}, i -> {least}) as m_"))
    out = out.select(*keep, "m_", F.expr("filter(if(size(m_) > 0, sequence(0, size(m_) - 1), cast(array() as array<int>)), i -> i = 0 or m_[i] <> m_[i - 1]) as s_"))
    return out.select(*keep, F.expr("transform(s_, (s, j) -> struct(m_[s] as fp, s as lo, if(j + 1 < size(s_), s_[j + 1], size(m_)) - 1 as hi)) as seeds"))


def _seeds(rows: DataFrame, spans: list[int], keep: list[str]) -> DataFrame:
    """keep, span, fp, lo, hi for every span asked for."""
    out = None
    for span in spans:
        # inline_outer: for inline the optimiser tests size(seeds) > 0 first and works them out twice, all steps in one.
        one = _winnowed(rows, span, keep).select(*keep, F.lit(span).alias("span"), F.inline_outer("seeds")).filter(F.col("fp").isNotNull())
        out = one if out is None else out.unionByName(one)
    return out


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _met(docs: DataFrame, bench: DataFrame, on: list[str], rows: int) -> DataFrame:
    """``docs`` (with id_) joined to ``bench``, which has one row for each key and so many rows."""
    if rows <= BROADCAST_ROWS:
        return docs.join(F.broadcast(bench), on)
    dealt = docs.withColumn("copy_", F.pmod(F.xxhash64("id_"), F.lit(COPIES)).cast("int"))
    return dealt.join(bench.withColumn("copy_", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))), [*on, "copy_"]).drop("copy_")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted array of strings), contaminated,
    spans (sorted array of (start, end): word positions of hit windows, the end exclusive).

    A document's word is hit if it lies in any occurrence of a window of ``span`` words in a row of a
    benchmark item; an item with fewer words is one window. Null and empty texts have no words.
    Items without an id or words are passed over; several items with the same id count as one.
    Repeated rows are answered each. Whole texts are read, and every occurrence is found.
    """
    items = benchmark.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item_"), words(item_text).alias("ws_"))
    sized = items.filter(F.size("ws_") > 0).withColumn("span_", F.least(F.size("ws_"), F.lit(span)))
    spans = sorted(r[0] for r in sized.select("span_").distinct().collect())  # at most ``span`` numbers
    keyed = docs.select(F.col(id).alias("id_"), F.xxhash64(F.col(text).cast("string")).alias("th_"), F.col(text).cast("string").alias("t_"))
    counted = keyed.select("id_", "th_", F.coalesce(F.regexp_count("t_", F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"))
    nothing = F.array().cast("array<string>"), F.array().cast("array<struct<start:int,end:int>>")
    if not spans:
        return counted.select(F.col("id_").alias(id), "n_words", F.lit(0).cast("long").alias("n_hit"), nothing[0].alias("items"), F.lit(False).alias("contaminated"), nothing[1].alias("spans"))

    # The benchmark's windows, each with the items it stands in, and its seeds.
    windows, seeds = None, None
    for n in spans:
        own = sized.filter(F.col("span_") == n)
        cut = own.select("item_", F.expr(f"transform(sequence(0, size(ws_) - {n}), i -> array_join(slice(ws_, i + 1, {n}), ' ')) as w_"))
        cut = cut.select("item_", F.lit(n).alias("span"), F.explode_outer("w_").alias("window")).filter(F.col("window").isNotNull())
        fps = _seeds(own, [n], []).select("span", "fp")
        windows, seeds = (cut, fps) if windows is None else (windows.unionByName(cut), seeds.unionByName(fps))
    windows = stored(windows.groupBy("span", "window").agg(F.sort_array(F.collect_set("item_")).alias("items")), "bench-windows")
    seeds = stored(seeds.distinct(), "bench-seeds")
    n_windows, n_entries = windows.agg(F.count("*"), F.sum(F.size("items"))).first()

    split = keyed.filter(F.col("t_") != "").select("id_", "th_", words("t_").alias("ws_"))
    met = _met(_seeds(split, spans, ["id_", "th_"]), seeds, ["span", "fp"], seeds.count())
    near = stored(met.groupBy("id_", "th_").agg(F.collect_set(F.struct("span", "lo", "hi")).alias("runs")), "bench-near")
    n_runs = near.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]

    # Only documents that hold a seed are split once more, for the windows that their seeds lie in.
    hit = near.select(F.col("id_").alias("i_"), F.col("th_").alias("h_"), "runs")
    again = keyed.join(_bounded(hit, n_runs), F.expr("id_ <=> i_ and th_ <=> h_")).select("id_", "th_", "runs", words("t_").alias("ws_"))
    tried = again.select("id_", "th_", F.expr("flatten(transform(runs, r -> transform(sequence(r.lo, least(r.hi, size(ws_) - r.span)), s -> struct(r.span as span, s as start, array_join(slice(ws_, s + 1, r.span), ' ') as window)))) as tried"))
    found = _met(tried.select("id_", "th_", F.inline_outer("tried")).filter(F.col("window").isNotNull()), windows, ["span", "window"], n_windows + (n_entries or 0))
    total = found.groupBy("id_", "th_").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("span")).alias("end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.expr("aggregate(spans, struct(0L as n, 0 as upto), (a, x) -> struct(a.n + greatest(0, x.end - greatest(x.start, a.upto)) as n, greatest(a.upto, x.end) as upto), a -> a.n)")
    total = stored(total.select(F.col("id_").alias("i_"), F.col("th_").alias("h_"), covered.alias("n_hit"), "items", "spans"), "bench-hits")
    return counted.join(total, F.expr("id_ <=> i_ and th_ <=> h_"), "left").select(
        F.col("id_").alias(id), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", nothing[0]).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("spans", nothing[1]).alias("spans"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH t AS (
  SELECT true AS doc, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark
), w AS (
  SELECT doc, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t
), i AS (SELECT CAST(id AS VARCHAR) AS item, w, least(len(w), 10) AS n FROM w WHERE NOT doc AND len(w) > 0),
b AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
d AS (SELECT id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM w, (SELECT DISTINCT n FROM b) WHERE doc AND len(w) >= n)),
h AS (SELECT id, n, s, item FROM d JOIN b USING (n, g)),
p AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(s, s + n)) AS p FROM h) GROUP BY 1),
m AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM h) GROUP BY 1)
SELECT w.id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN p USING (id) LEFT JOIN m USING (id) WHERE doc
"""
