"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``, extra
ones included, whatever their names. Null and empty texts pass every stage: they are judged as empty, are nobody's copies,
hold no passage and no secret, and are packed as an end mark alone. Whole texts are read, however long, and an empty
table stays empty. Repeated rows are judged each; what else a stage does with them, nulls and ties, it says itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import others, small, stored, table
from gaugeworks.llm.decontaminate import decontaminate
from gaugeworks.llm.jaccard import ngram_jaccard_join
from gaugeworks.llm.ledger import redact, scan_versions
from gaugeworks.llm.packing import pack
from gaugeworks.llm.quality import quality

#: Most ids that are broadcast to the texts; beyond it the texts are shuffled to meet them.
BROADCAST_IDS = 1_000_000


def _aside(docs: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """The needed columns and all others under names that no operator uses."""
    rest = others(docs, needed)
    return docs.select(*needed, *(F.col(f"`{c}`").alias(f"__kept_{i}") for i, c in enumerate(rest)))


def _back(made: DataFrame, docs: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    places = {c: f"__kept_{i}" for i, c in enumerate(others(docs, needed))}
    return made.select(*(F.col(places.get(c, c)).alias(c) for c in docs.columns))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but the rows whose doc_id is among ``ids``, a frame of that column."""
    ids = stored(ids.filter("doc_id is not null").distinct().withColumnRenamed("doc_id", "__gone"), "pipeline-gone")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col("doc_id") == F.col("__gone"), "left_anti")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects: poor text, and toxic text. A null source or lang is a site of its own;
    a document at a threshold stays. Of several labels of one id the greater quality counts."""
    needed = ("doc_id", "text", "lang", "source")
    kept = quality(_aside(docs, needed), table(spark, sf_dir, "labels")).filter("accepted")
    return _back(kept, docs, needed)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of similar texts; of rows with one doc_id, the one with the greatest text. Rows without a doc_id
    stay, and none gives way to them."""
    told = stored(ngram_jaccard_join(docs.select("doc_id", "text")), "pipeline-groups")
    kept = _without(docs, told.filter("doc_id <> component_id").select("doc_id"))
    again = told.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if not again:
        return kept
    # The row with the greatest text, and of these the one with the greatest hash of all its columns: copies meet before they are dealt out.
    told = [c for c, kind in kept.dtypes if "map<" not in kind]
    row = F.max_by(F.struct(*(F.col(f"`{c}`") for c in kept.columns)), F.struct("text", F.xxhash64(*(F.col(f"`{c}`") for c in told))))
    one = kept.filter("doc_id is not null").groupBy("doc_id").agg(row.alias("__row")).select("__row.*")
    return one.unionByName(kept.filter("doc_id is null"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with words of a benchmark item's window. The text alone decides, so rows that share a doc_id,
    or have none, are judged each by its own."""
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    told = decontaminate(docs.select(key.alias("key"), "text"), table(spark, sf_dir, "benchmark"), id="key")
    gone = stored(told.filter("contaminated").select(F.col("key").alias("__gone")).distinct(), "pipeline-gone")
    return docs.join(small(gone, BROADCAST_IDS), key == F.col("__gone"), "left_anti")


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts, and counts n_chars anew where one was. Overlapping ones become one mask."""
    needed = ("text", "n_chars")
    found, _ = scan_versions(_aside(docs, needed))
    found = found.withColumn("__hit", F.size("findings") > 0).withColumn("text", redact())
    return _back(found.withColumn("n_chars", F.when(F.col("__hit"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))), docs, needed)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in sequences of 1024 tokens; ids as little-endian unsigned 32-bit. Rows with one doc_id, or none,
    are packed each."""
    return pack(docs)


STAGES = [
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", clean),
    ("secret scans", masked),
    ("packing", packed),
]

#: SQL can't express the classifier and the tokenizer; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
