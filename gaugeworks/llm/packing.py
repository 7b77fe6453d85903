"""Concatenate-and-cut packing of tokenised texts into sequences of one length.

Pass one tokenises every partition once, keeps each document's place within its partition, and
writes the ids to the shared folder. The partitions' token totals are summed up in order, which
gives each partition's global offset. Pass two cuts the one long sequence at every multiple of the
length; a document that crosses a cut becomes several pieces.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import small, stored, table, vocabulary

END_ID = 0
#: Most partitions whose offsets are broadcast; beyond it they are joined by shuffling.
BROADCAST_PARTITIONS = 200_000
#: Longer texts are encoded in pieces, cut at a blank between two letters or digits, where the pattern always cuts; a text
#: without such a blank is encoded whole, which takes more memory and gives the same ids.
PIECE_CHARS = 1_000_000
_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE_CHARS:
        m = _CUT.search(text, at + PIECE_CHARS)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def byte_bpe(name: str = "byte_bpe_50k"):
    """A function from a text to its ids, as the tokenizers library gives them for ``name``.json.

    The .tiktoken file beside it holds the same vocabulary as ranks, which is several times
    faster to apply. The special string in a text is its id, as is that library's default.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary(f"{name}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    special = {"<|endoftext|>": len(ranks)}
    model = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)

    def encode(text: str) -> list[int]:
        if len(text) <= PIECE_CHARS:
            return model.encode(text, allowed_special=allowed, disallowed_special=())
        return [i for piece in _pieces(text) for i in model.encode(piece, allowed_special=allowed, disallowed_special=())]

    return encode


def tokenised(docs: DataFrame, id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k") -> DataFrame:
    """id, ids (little-endian unsigned 32-bit, END_ID last), n, and each document's place: part, at.

    Stored in the shared folder, as a place holds only for the task that gave it. Null: empty text.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            encode = encode or byte_bpe(name)
            for a in range(0, batch.num_rows, 128):
                some = batch.slice(a, 128)
                ids = [np.array([*encode(t.as_py() or ""), END_ID], "<u4") for t in some.column(1)]
                n = np.array([len(x) for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                columns = [some.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(starts)]
                yield pa.RecordBatch.from_arrays(columns, ["id_", "ids", "n", "part", "at"])

    source = docs.select(docs[id].alias("id_"), docs[text].cast("string").alias("text_"))
    return stored(source.mapInArrow(run, f"id_ {kind}, ids binary, n long, part int, at long"), "packing-ids")


def pack(docs: DataFrame, length: int = 1024, id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: the id, start, length, ids (binary), doc_tokens, sequence_id, offset.

    All sequences but the last are full; none is padded here. Null and empty texts are END_ID
    alone. Repeated rows are packed each. An empty table gives no rows.
    """
    if length < 1:
        raise ValueError("length must be positive")
    ids = tokenised(docs, id, text, name)
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    # One row for each task of pass one.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "packing-bases")
    placed = ids.join(small(bases, BROADCAST_PARTITIONS), "part").withColumn("g", F.col("base") + F.col("at"))
    pieces = F.expr(f"""transform(sequence(g div {length}, (g + n - 1) div {length}), s -> named_struct(
        'start', greatest(s * {length} - g, 0L),
        'length', least((s + 1) * {length}, g + n) - greatest(s * {length}, g),
        'ids', substring(ids, cast(4 * greatest(s * {length} - g, 0L) + 1 as int), cast(4 * (least((s + 1) * {length}, g + n) - greatest(s * {length}, g)) as int)),
        'doc_tokens', n, 'sequence_id', s, 'offset', greatest(g - s * {length}, 0L)))""")
    return placed.select(F.col("id_").alias(id), F.inline(pieces))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_digest(pack(table(spark, sf_dir, "documents")))


def pieces_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
