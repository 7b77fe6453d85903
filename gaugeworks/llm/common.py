"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gaugeworks.storage import keyed_join, shared_dir, small, stored  # noqa: F401

#: Bytes of text that a task turns into arrays at once.
SEGMENT_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that add up to at most ``most`` each; a larger row stands alone."""
    start = total = end = 0
    for size in sizes:
        if end > start and total + size > most:
            yield start, end
            start, total = end, 0
        total, end = total + size, end + 1
    if end > start:
        yield start, end


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine, driver or executor."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def others(df: DataFrame, made: Iterable[str]) -> list[str]:
    """The columns of ``df`` but those that an operator makes itself; names differ by more than case."""
    own = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in own]
