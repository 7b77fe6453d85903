"""Sorted spans of readings, one after another, inside a task: for what no window function says."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a result after which a batch is passed on, and rows of small groups that are looked at together.
PASSED_ROWS, GROUPED_ROWS = 10_000, 100_000


def _ends(column: pa.Array) -> np.ndarray:
    return pc.run_end_encode(column).run_ends.to_numpy() if len(column) else np.zeros(0, np.int32)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows that agree in the first ``keys`` columns and stand together."""
    key, held = None, []
    for batch in batches:
        start = 0
        for end in np.unique(np.concatenate([_ends(batch.column(i)) for i in range(keys)])).tolist():
            own = tuple(batch.column(i)[start].as_py() for i in range(keys))
            if held and own != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield key, pa.Table.from_batches(held)


def several(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The same groups, whole, but so many at a time that small ones don't cost a call each."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < GROUPED_ROWS:
            continue
        table = pa.Table.from_batches(held)
        ends = (_ends(table.column(i).combine_chunks()) for i in range(keys))
        last = max(int(e[-2]) if len(e) > 1 else 0 for e in ends)
        if last:
            yield table.slice(0, last)
            held, size = table.slice(last).to_batches(), len(table) - last
    if size:
        yield pa.Table.from_batches(held)


def numbered(table: pa.Table, keys: int) -> np.ndarray:
    """Which of the groups, from 0, each row belongs to."""
    ends = np.unique(np.concatenate([_ends(table.column(i).combine_chunks()) for i in range(keys)]))
    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))


def per_group(df: DataFrame, by: list[str], order: list[str], columns: list[str], make: Callable[[tuple, pa.Table], Iterator[tuple] | pa.Table], schema: str | StructType) -> DataFrame:
    """What ``make`` returns for every group of ``by``, whose rows it gets in ``order``: rows as tuples, or a table. A group is held
    by one task, one group at a time."""
    arrow = arrow_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in groups(batches, len(by)):
            got = make(key, table)
            yield from got.cast(arrow).to_batches() if isinstance(got, pa.Table) else got

    passed = lambda batches: passed_on(run(batches), arrow)
    return sorted_groups(df, by, order, columns).mapInArrow(passed, schema)


def sorted_groups(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The rows of each group of ``by`` together in one partition, in ``order``; ``by`` come first."""
    return df.select(*dict.fromkeys([*by, *order, *columns])).repartition(*by).sortWithinPartitions(*by, *order)


def arrow_of(schema: str | StructType) -> pa.Schema:
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    return pa.schema([(f.name, f.type) for f in arrow])


def passed_on(rows: Iterator[tuple | pa.RecordBatch], arrow: pa.Schema, most: int = PASSED_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches as they are, and tuples in batches of ``most``."""
    out: list[tuple] = []
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
    for row in rows:
        if isinstance(row, pa.RecordBatch):
            yield row
            continue
        out.append(row)
        if len(out) >= most:
            yield batch_of()
            out.clear()
    if out:
        yield batch_of()
