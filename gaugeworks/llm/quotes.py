"""Quotation linking: who answers whom, told from quoted passages, in DataFrame operations only.

Lines that begin with '>' are quotes, of as many levels as they have marks. Runs of lines of one level are
passages. A passage's words in lower case, hashed, are looked up among the hashes of what
messages of the same thread say themselves: their whole own text, and each of their own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import keyed_join, stored, table

_MARKS = r"^((?:\s*>)+)\s?"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(messages: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, own (text without quotes), own_lines, and passages: array of (level, text, lines)."""
    line = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"\r?\n")
    marked = messages.select(*keep, F.transform(line, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS, "").alias("text"))).alias("l_"))
    starts = marked.select(*keep, "l_", F.expr("filter(sequence(0, size(l_) - 1), i -> i = 0 or l_[i].level <> l_[i - 1].level) as s_"))
    cut = "slice(l_, s + 1, if(j + 1 < size(s_), s_[j + 1], size(l_)) - s).text"
    runs = starts.select(*keep, F.expr(f"transform(s_, (s, j) -> struct(l_[s].level as level, {cut} as lines)) as r_"))
    quoted = F.transform(F.filter("r_", lambda r: r["level"] > 0), lambda r: F.struct(r["level"].alias("level"), F.array_join(r["lines"], "\n").alias("text"), r["lines"].alias("lines")))
    mine = F.flatten(F.transform(F.filter("r_", lambda r: r["level"] == 0), lambda r: r["lines"]))
    out = runs.select(*keep, mine.alias("own_lines"), quoted.alias("passages"))
    return out.withColumn("own", F.regexp_replace(F.array_join("own_lines", "\n"), r"^\s+|\s+$", ""))


def _hashed(texts: Column) -> Column:
    """Distinct (hash, size) of texts with words."""
    known = F.filter(F.transform(texts, lambda x: _normal(x)), lambda x: x != "")
    return F.transform(F.array_distinct(known), lambda x: F.struct(F.sha2(x, 256).alias("hash"), F.length(x).alias("size")))


def link_quotes(messages: DataFrame, thread: str = "thread", order: str = "turn", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Conversations in reply order, and the links of their passages.

    The first frame: thread, order, own (the text without quotes), parent, root, depth: sorted by thread,
    root, depth and order every message follows the one it answers. The second: thread, order,
    passage (its number), level, original (the earliest message that says it, before the one that quotes).
    A passage is looked up whole; if nobody said it whole, by its longest line that someone said. The parent is the
    original of the longest linked passage of level 1, the later passage on equal length; none: a root.

    Rows are told apart by thread and order; repeated rows become one (the greatest text). Rows with a null
    thread or order are left out. Null and empty texts own nothing and quote nothing.
    """
    base = messages.select(F.col(thread).alias("t"), F.col(order).alias("o"), F.col(text).cast("string").alias("x")).filter("t is not null and o is not null")
    m = stored(parsed(base.groupBy("t", "o").agg(F.max("x").alias("x")), ["t", "o"], "x"), "quotes-parsed")
    said = m.select("t", "o", F.explode(_hashed(F.array_append("own_lines", F.col("own")))).alias("h"))
    first = said.groupBy("t", "h.hash").agg(F.min("o").alias("original"))
    asked = m.select("t", "o", F.posexplode("passages").alias("passage", "p"))
    whole = asked.select("t", "o", "passage", "p.level", F.lit(1).alias("whole"), F.explode(_hashed(F.array(F.col("p.text")))).alias("h"))
    parts = asked.select("t", "o", "passage", "p.level", F.lit(0).alias("whole"), F.explode(_hashed(F.col("p.lines"))).alias("h"))
    units = whole.unionByName(parts).select("t", "o", "passage", "level", "whole", "h.hash", "h.size")
    found = keyed_join(stored(units, "quotes-units"), first, ["t", "hash"]).filter("original < o")
    links = stored(found.groupBy("t", "o", "passage", "level").agg(F.max(F.struct("whole", "size", "original")).alias("b")).select("t", "o", "passage", "level", "b.size", "b.original"), "quotes-links")
    parents = links.filter("level = 1").groupBy("t", "o").agg(F.max(F.struct("size", "passage", "original"))["original"].alias("parent"))
    # Depths by doubling: each round every message jumps as far again as it has come. A root that many answer is no one task's.
    now = stored(m.select("t", "o").join(parents, ["t", "o"], "left").select("t", "o", "parent", F.coalesce("parent", "o").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")), "quotes-depth")
    done, open_ = now.filter("depth = 0"), now.filter("depth > 0")
    while True:
        up = done.unionByName(open_).filter("depth > 0").select("t", F.col("o").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        jumped = keyed_join(open_, up, ["t", "root"], "left").select("t", "o", "parent", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("moved"))
        now = stored(jumped, "quotes-depth")
        # Who didn't move stands at its root; only the others go on.
        done, open_ = done.unionByName(now.filter("not moved").drop("moved")), now.filter("moved").drop("moved")
        if not open_.limit(1).count():
            break
    now = done
    out = m.select("t", "o", "own").join(now, ["t", "o"])
    named = lambda df, *more: df.select(F.col("t").alias(thread), F.col("o").alias(order), *more)
    return named(out, "own", "parent", "root", "depth"), named(links, "passage", "level", "original")


def quoted_messages(conversations: DataFrame) -> DataFrame:
    """conversations as a mail thread would hold them: each turn quotes the turn before, and in it the one before that."""
    c = conversations.select("conv_id", "turn", "text")
    before = lambda n: c.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(f"text_{n}"))
    quote = lambda text, marks: F.when(F.col(text).isNotNull(), F.regexp_replace(F.col(text), "(?m)^", marks))
    met = c.join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left")
    return met.select("conv_id", "turn", F.concat_ws("\n", quote("text_2", ">> "), quote("text_1", "> "), "text").alias("text"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, links = link_quotes(quoted_messages(table(spark, sf_dir, "conversations")), "conv_id")
    count = links.groupBy("conv_id", "turn").agg(F.count("*").alias("n_links"))
    return told.join(count, ["conv_id", "turn"], "left").select("conv_id", "turn", F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"), "depth", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.sha2("own", 256).alias("own_sha256"))


#: Holds where no text has a line that begins with '>' or is another's line.
OP8_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS own, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS norm FROM conversations
), f AS (SELECT conv_id, norm, min(turn) AS original FROM c WHERE norm <> '' GROUP BY ALL),
l AS (
  SELECT c.conv_id, c.turn, k.n AS level, f.original FROM c, (VALUES (1), (2)) k(n)
  JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.turn - k.n JOIN f ON f.conv_id = p.conv_id AND f.norm = p.norm WHERE f.original < c.turn
), e AS (
  SELECT c.conv_id, c.turn, c.own, l.original AS parent_turn, (SELECT count(*) FROM l k WHERE k.conv_id = c.conv_id AND k.turn = c.turn) AS n_links
  FROM c LEFT JOIN l ON l.conv_id = c.conv_id AND l.turn = c.turn AND l.level = 1
), r AS (
  SELECT conv_id, turn, turn AS root_turn, 0 AS depth FROM e WHERE parent_turn IS NULL
  UNION ALL SELECT e.conv_id, e.turn, r.root_turn, r.depth + 1 FROM r JOIN e ON e.conv_id = r.conv_id AND e.parent_turn = r.turn
)
SELECT conv_id, turn, parent_turn, root_turn, CAST(depth AS BIGINT) AS depth, n_links, sha256(own) AS own_sha256 FROM e JOIN r USING (conv_id, turn)
"""
