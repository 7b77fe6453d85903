"""Token counts with a digest cache.

A text's key is the digest of its normalised content and of the tokenizer's version. Counts of
known keys come from the cache; each distinct miss is encoded once and appended.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import keyed_join, others, slices, small, stored, table, vocabulary

CACHE = "digest string, n_tokens long"
#: Most distinct words whose counts a worker keeps at a time, for vocabularies that split at white space.
WORDS_KEPT = 300_000


#: Most digests of misses that are broadcast to the texts; beyond it both sides are shuffled.
BROADCAST_DIGESTS = 300_000
#: Patterns of words between which white space is dropped. No match holds white space or begins or
#: ends otherwise because of what lies beyond it, so a text's tokens are those of its words.
WORD_PATTERNS = ("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",)


@cache
def drops_blanks(name: str) -> bool:
    """Whether the vocabulary drops white space before it merges, as told by its file: then words can be counted
    one by one, and runs of white space are the same content as one blank."""
    path = vocabulary(name)
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as file:
        made = json.load(file)["pre_tokenizer"] or {}
    first = (made.get("pretokenizers") or [made])[0]
    return first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and first["pattern"].get("Regex") in WORD_PATTERNS


def counter(name: str):
    """A function from texts to their numbers of tokens, without added special tokens.

    name: of a vocabulary file, .json (tokenizers) or .model (sentencepiece). Where the vocabulary
    drops white space a text's count is the sum of its words' counts, and each word between ASCII white
    space is encoded once, as it stands, while a worker keeps it.
    """
    path = vocabulary(name)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(model.encode(t)) for t in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def encode(texts: list[str]) -> list[int]:
        sizes: list[int] = []
        for a, b in slices(map(len, texts), 300_000):
            sizes += [len(e.ids) for e in model.encode_batch_fast(texts[a:b], add_special_tokens=False)]
        return sizes

    if not drops_blanks(name):
        return encode
    kept: dict[bytes, int] = {}

    def count(texts: list[str]) -> list[int]:
        out: list[int] = []
        for a, b in slices(map(len, texts), 500_000):
            split = [t.encode().split() for t in texts[a:b]]
            new = [w for w in set().union(*split) if w not in kept]
            if len(kept) + len(new) > WORDS_KEPT:
                kept.clear()
                new = list(set().union(*split))
            kept.update(zip(new, encode([w.decode() for w in new])))
            out += [sum(map(kept.__getitem__, words)) for words in split]
        return out

    return count


_COUNTERS: dict = {}


def shared_counter(name: str):
    """One counter for each worker process, however many tasks it runs."""
    if name not in _COUNTERS:
        _COUNTERS[name] = counter(name)
    return _COUNTERS[name]


def normalised(text: Column, name: str) -> Column:
    """The content that decides the count: null is empty; where the vocabulary drops white space,
    runs of ASCII white space count as one blank."""
    content = F.coalesce(text.cast("string"), F.lit(""))
    return F.regexp_replace(content, r"[ \t\n\x0B\f\r]+", " ") if drops_blanks(name) else content


def _encode(misses: DataFrame, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared_counter(name)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64()), part.column(2)], ["digest", "n_tokens", "__rows"])

    return misses.select("digest", "__content", "__rows").mapInArrow(run, f"{CACHE}, __rows long")


def token_counts(docs: DataFrame, name: str, version: str = "1", cache: DataFrame | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``docs`` with digest and n_tokens, and the rows to append to the cache.

    cache: rows as CACHE from earlier calls, or None. The second frame is stored in the shared
    folder. Null texts count as empty; equal contents are encoded once and repeated rows stay.
    Columns of ``docs`` named digest or n_tokens give way. Whole texts are counted.
    """
    columns = others(docs, ("digest", "n_tokens"))
    content = normalised(F.col(text), name)
    digest = F.sha2(F.concat_ws("\n", F.lit(name), F.lit(version), content), 256)
    asked = docs.select(digest.alias("digest"), content.alias("__content"))
    if cache is None:
        # One content for each digest: copies meet in the partial aggregate before they are dealt out.
        made = stored(_encode(asked.groupBy("digest").agg(F.first("__content").alias("__content"), F.count("*").alias("__rows")), name), "token-cache")
        known, added = made, made.drop("__rows")
    else:
        # Digests alone tell the misses; no text that the cache knows is moved.
        rows = stored(asked.groupBy("digest").agg(F.count("*").alias("__rows")), "token-asked")
        missing = stored(rows.join(cache.select("digest").distinct(), "digest", "left_anti"), "token-misses")
        lacking = asked.join(small(missing.select("digest"), BROADCAST_DIGESTS), "digest", "left_semi")
        added = stored(_encode(lacking.groupBy("digest").agg(F.first("__content").alias("__content"), F.count("*").alias("__rows")), name), "token-cache").drop("__rows")
        every = added.unionByName(cache.groupBy("digest").agg(F.first("n_tokens").alias("n_tokens")))
        known = stored(rows.join(every, "digest"), "token-known")
    # The digest of an empty or much repeated text is no one task's.
    joined = keyed_join(docs.select(*columns, digest.alias("digest")), known, ["digest"], "left", by=[c for c in columns if "map<" not in dict(docs.dtypes)[c]] or ["digest"])
    return joined.select(*columns, "digest", "n_tokens"), added


def op6(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    """Documents arrive in two batches, told apart by a hash of doc_id; the second is joined to what the first has stored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    early = F.xxhash64("doc_id") < 0
    first, cache = token_counts(sized.filter(early), "word_bpe_49k.json")
    second, _ = token_counts(sized.filter(~early), "word_bpe_49k.json", cache=cache)
    return first.unionByName(second).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
