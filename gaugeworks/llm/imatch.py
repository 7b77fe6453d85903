"""Document fingerprints by I-Match, in DataFrame operations only.

A lexicon holds the terms whose inverse document frequency lies in a band: neither those that stand everywhere nor those that hardly
stand anywhere. A text is known by the hash of its distinct terms in the lexicon; and, so that a
few changed terms don't hide a likeness, once more for each of several random subsets of the lexicon, of several sizes: two texts
agree in a subset where none of their differing terms falls into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import stored, table
from gaugeworks.llm.decontaminate import words

#: The band of ln(documents / documents with the term). Its upper end bounds the lexicon: at most exp(IDF_HIGH) terms for each distinct term that
#: a document has on average.
IDF_LOW, IDF_HIGH = 1.5, 8.0
#: Shares of the lexicon that subsets keep, as powers of two, and how many subsets of each.
KEPT_BITS, SUBSETS_EACH = (1, 3, 5, 7), 8
SUBSETS = len(KEPT_BITS) * SUBSETS_EACH
#: Hexadecimal digits of the whole lexicon's signature, and of each subset's.
WHOLE_DIGITS, DIGITS = 15, 8
#: Most terms that are broadcast to the texts; beyond it they are joined by shuffling.
BROADCAST_TERMS = 1_000_000
#: Rows of a run of ids in which neighbours are looked up, about, and most runs.
RUN_ROWS, RUNS = 2_000, 4_096


def lexicon(docs: DataFrame, text: str = "text", low: float = IDF_LOW, high: float = IDF_HIGH) -> DataFrame:
    """term, hash and mask (bit i: subset i keeps it) for the terms of the band. docs: any rows; all count. Of an empty table, nothing."""
    n = docs.count()
    seen = docs.select(F.explode(F.array_distinct(words(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # ln(n / df) within the band, asked of whole numbers.
    band = seen.filter((F.ln(F.lit(float(max(n, 1))) / F.col("df")) >= low) & (F.ln(F.lit(float(max(n, 1))) / F.col("df")) <= high))
    return band.select("term", F.conv(F.substring(F.md5("term"), 1, WHOLE_DIGITS), 16, 10).cast("long").alias("hash"), _mask(F.col("term")).alias("mask"))


def _mask(term: Column) -> Column:
    """Subset i keeps a term if the last bits of a hash of both are 0."""
    out = F.lit(0).cast("long")
    for i in range(SUBSETS):
        bits = KEPT_BITS[i // SUBSETS_EACH]
        digit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{i}:"), term)), 1, 4), 16, 10).cast("int")
        out = out.bitwiseOR(F.when(F.pmod(digit, F.lit(1 << bits)) == 0, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _runs(docs: DataFrame, id: str, rows: int) -> Column:
    """The number of the run of ids, from the greatest id down, that each row stands in; rows without an id are last.

    Runs are cut at quantiles of the ids. An id with more rows than a run has its own, dealt by a hash of the text, in the hash's order.
    """
    n = docs.count()
    many = max(1, min(RUNS, -(-n // rows)))
    marks = docs.agg(F.percentile_approx(F.col(id), [i / many for i in range(1, many)], 100 * many).alias("m")).first()["m"] if many > 1 else []
    cuts = sorted(set(marks or []))
    heavy = sorted({m for m, after in zip(marks or [], (marks or [])[1:]) if m == after})
    literal = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast(f"array<{docs.schema[id].dataType.simpleString()}>")
    below = F.size(F.filter(literal(cuts), lambda c: c < F.col(id))) if cuts else F.lit(0)
    own = F.array_contains(literal(heavy), F.col(id)) if heavy else F.lit(False)
    dealt = (own | F.col(id).isNull()) if many > 1 else F.lit(False)
    part = F.when(dealt, F.conv(F.substring("h_", 1, 3), 16, 10).cast("int")).otherwise(F.lit(0))
    return F.struct(F.when(F.col(id).isNull(), F.lit(1)).otherwise(-(2 * below + F.when(own, 1).otherwise(0))).alias("at"), part.alias("part"))


def neighbours(docs: DataFrame, id: str, text: str, rows: int = RUN_ROWS) -> DataFrame:
    """id_, t_, h_ (the text's digest), run_, i_ (place in the run), next_ (the next row's text, by descending id; the first's after the last) and own_, false for a
    row that only stands at the end of a run as the first of the next.

    Of equal ids the text with the smaller digest comes first; rows without an id come last.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(id).alias("id_"), t.alias("t_")).withColumn("h_", F.sha2("t_", 256))
    base = base.withColumn("run_", _runs(base, "id_", rows))
    # The first row of every run, found by its key alone and then fetched: it is the row after the last of the run before.
    first = base.groupBy("run_").agg(F.min(F.struct((-F.col("id_")).alias("back"), "h_")).alias("k"))
    first = stored(first.select("run_", F.col("k.h_").alias("first_h")), "imatch-runs")
    order = Window.orderBy("run_")  # one row a run
    turned = first.select(F.col("run_").alias("from_"), "first_h", F.lag("run_").over(order).alias("before_"), F.max("run_").over(Window.partitionBy()).alias("last_"))
    turned = F.broadcast(turned.select("from_", "first_h", F.coalesce("before_", "last_").alias("to_")))  # at most RUNS quantiles, each with at most 4,096 parts if an id is heavy
    ends = base.join(turned, F.expr("run_ = from_ and h_ = first_h")).groupBy("to_", "h_").agg(F.first("t_").alias("t_"))
    ends = ends.select(F.lit(None).cast(base.schema["id_"].dataType).alias("id_"), "t_", "h_", F.col("to_").alias("run_"), F.lit(False).alias("own_"))
    both = base.withColumn("own_", F.lit(True)).unionByName(ends)
    order = Window.partitionBy("run_").orderBy(F.desc("own_"), F.desc_nulls_last("id_"), "h_")
    return both.select("*", F.row_number().over(order).alias("i_"), F.lead("t_").over(order).alias("next_"))


def fingerprint(terms: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """keys and f: digits of the whole lexicon's signature, then of each subset's; a subset without any of the terms is dashes. Rows of ``terms``: keys and a
    term, each once, or null; f is null where no term is in the lexicon.

    A signature is the hash of a set of terms: their hashes, one upon another. That is what hashing them in sorted order tells, equal sets and no
    others, but no list of terms is held, moved or sorted: a text is a few numbers in the aggregation's own table.
    """
    met = terms.join(known, "term", "left")
    some = [F.bit_xor(F.when(F.col("mask").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.col("hash"))).alias(f"x{i}") for i in range(SUBSETS)]
    told = met.groupBy(*keys).agg(F.bit_xor("hash").alias("x"), *some)
    digits = lambda c, n: F.right(F.lpad(F.lower(F.hex(c)), WHOLE_DIGITS, "0"), F.lit(n))
    return told.select(*keys, F.concat(digits("x", WHOLE_DIGITS), *(F.coalesce(digits(f"x{i}", DIGITS), F.lit("-" * DIGITS)) for i in range(SUBSETS))).alias("f"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints; else the share of subsets with equal signatures among those that either text has terms of."""
    at = lambda f, i: F.substring(f, WHOLE_DIGITS + 1 + DIGITS * i, DIGITS)
    none = "-" * DIGITS
    same = sum((F.when((at(a, i) == at(b, i)) & (at(a, i) != none), 1.0).otherwise(0.0) for i in range(SUBSETS)), F.lit(0.0))
    told = sum((F.when((at(a, i) != none) | (at(b, i) != none), 1.0).otherwise(0.0) for i in range(SUBSETS)), F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(same, told), F.lit(0.0)))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", rows: int = RUN_ROWS) -> DataFrame:
    """A row for each row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by as much of the beginning of the next text. A text none of whose terms is in the lexicon is
    fingerprinted by its own digest, the same in all subsets. Equal texts have equal
    fingerprints. Null is an empty text; repeated rows and ids are answered each, of equal ids the text with the smaller digest first, null ids
    last; one row is its own next; an empty table gives no rows. Other columns are not looked at. Whole texts are read, and the lexicon counts all rows.
    """
    known = stored(lexicon(docs, text), "imatch-lexicon")
    near = neighbours(docs, id, text, rows)
    size = F.char_length("t_")
    half = F.call_function("div", size, F.lit(2)).cast("int")
    near = near.withColumn("n_", size.cast("long")).withColumn("edited_", F.when(F.col("own_"), F.concat(F.substring("t_", F.lit(1), size - half), F.substring("next_", F.lit(1), half))))
    if known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        known = F.broadcast(known)
    # A row for each term and the side that holds it, and one without a term for each side.
    held = F.expr("transform(concat(array(null), a_, array(null), b_), (x, i) -> struct(x as term, i <= size(a_) as left_))")
    rows_ = near.select("run_", "i_", "id_", "own_", "n_", "h_", F.sha2("edited_", 256).alias("sha_"), F.array_distinct(words("t_")).alias("a_"), F.array_distinct(words("edited_")).alias("b_"))
    rows_ = rows_.select("run_", "i_", "id_", "own_", "n_", "h_", "sha_", F.explode(held).alias("one"))
    doc = ["run_", "i_", "id_", "own_", "n_", "h_", "sha_"]
    sides = fingerprint(rows_.select(*doc, "one.*"), [*doc, "left_"], known)
    digest = F.when(F.col("left_"), F.col("h_")).otherwise(F.col("sha_"))
    instead = F.concat(F.substring(digest, 1, WHOLE_DIGITS), F.repeat(F.substring(digest, 1, DIGITS), F.lit(SUBSETS)))
    sides = sides.withColumn("f", F.coalesce("f", instead))
    made = sides.groupBy(*doc).agg(F.max(F.when(F.col("left_"), F.col("f"))).alias("f_"), F.max(F.when(~F.col("left_"), F.col("f"))).alias("g_"))
    after = made.withColumn("after_", F.lead("f_").over(Window.partitionBy("run_").orderBy("i_"))).filter("own_")
    return after.select(
        F.col("id_").alias(id), F.col("n_").alias("n_chars"), F.col("sha_").alias("edited_sha256"), F.col("f_").alias("fingerprint"), F.col("g_").alias("edited_fingerprint"),
        likeness(F.col("f_"), F.col("g_")).alias("near_edited"), likeness(F.col("f_"), F.col("after_")).alias("near_next"),
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def _mask_sql() -> str:
    tests = []
    for i in range(SUBSETS):
        tests.append(f"CASE WHEN CAST('0x' || substring(md5('{i}:' || term), 1, 4) AS INTEGER) % {1 << KEPT_BITS[i // SUBSETS_EACH]} = 0 THEN {1 << i}::BIGINT ELSE 0 END")
    return " + ".join(tests)


def _side_sql(side: str) -> str:
    """Fingerprints of one side's texts by their terms in the lexicon."""
    digits = lambda x, n: f"coalesce(right(printf('%015x', {x}), {n}), '{'-' * n}')"
    subset = ", ".join(digits(f"bit_xor(hash) FILTER (mask & {1 << i} <> 0)", DIGITS) for i in range(SUBSETS))
    return f"""SELECT k, {digits('bit_xor(hash)', WHOLE_DIGITS)} || concat({subset}) AS f FROM (SELECT k, unnest(list_distinct({side})) AS term FROM w) JOIN l USING (term) GROUP BY 1"""


def _likeness_sql(a: str, b: str) -> str:
    at = lambda f, i: f"substring({f}, {WHOLE_DIGITS + 1 + DIGITS * i}, {DIGITS})"
    none = "'" + "-" * DIGITS + "'"
    same = " + ".join(f"CAST({at(a, i)} = {at(b, i)} AND {at(a, i)} <> {none} AS INTEGER)" for i in range(SUBSETS))
    told = " + ".join(f"CAST({at(a, i)} <> {none} OR {at(b, i)} <> {none} AS INTEGER)" for i in range(SUBSETS))
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE coalesce(({same})::DOUBLE / nullif({told}, 0), 0) END"


def _digest_sql(text: str) -> str:
    return f"substring(sha256({text}), 1, {WHOLE_DIGITS}) || repeat(substring(sha256({text}), 1, {DIGITS}), {SUBSETS})"


_WORDS_SQL = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, sha256(coalesce(text, ''))) AS k FROM documents),
e AS (SELECT a.k, a.doc_id, a.t, b.k AS after, substring(a.t, 1, length(a.t) - length(a.t) // 2) || substring(b.t, 1, length(a.t) // 2) AS u FROM d AS a JOIN d AS b ON b.k = a.k % (SELECT count(*) FROM d) + 1),
w AS (SELECT *, {_WORDS_SQL.format('t')} AS a, {_WORDS_SQL.format('u')} AS b FROM e),
f AS (SELECT term, count(*) AS df FROM (SELECT k, unnest(list_distinct(a)) AS term FROM w) GROUP BY 1),
l AS (SELECT term, CAST('0x' || substring(md5(term), 1, {WHOLE_DIGITS}) AS BIGINT) AS hash, {_mask_sql()} AS mask FROM f WHERE ln((SELECT count(*) FROM d)::DOUBLE / df) BETWEEN {IDF_LOW} AND {IDF_HIGH}),
x AS ({_side_sql('a')}), y AS ({_side_sql('b')}),
z AS (SELECT w.k, w.after, w.doc_id, length(w.t) AS n_chars, sha256(w.u) AS edited_sha256, coalesce(x.f, {_digest_sql('w.t')}) AS f, coalesce(y.f, {_digest_sql('w.u')}) AS g FROM w LEFT JOIN x USING (k) LEFT JOIN y USING (k))
SELECT z.doc_id, z.n_chars, z.edited_sha256, z.f AS fingerprint, z.g AS edited_fingerprint, {_likeness_sql('z.f', 'z.g')} AS near_edited, {_likeness_sql('z.f', 'n.f')} AS near_next FROM z JOIN z AS n ON n.k = z.after
"""
