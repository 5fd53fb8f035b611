"""Groups of bounded size in sorted partitions, without a Python call per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows of one key in one partition, side by side."""
    return df.repartition(key).sortWithinPartitions(key)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, one table at a time; ``batches`` come sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.names.index(key))
        change = pc.not_equal(values.slice(1), values.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        if held and held[-1].column(key)[-1] != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        for low, high in zip(edges, edges[1:], strict=False):
            if low:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def gathered(parts: Iterator[pa.RecordBatch | pa.Table], rows: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Small results joined into batches of about ``rows``."""
    held, n = [], 0
    for part in parts:
        if part.num_rows:
            held.append(pa.Table.from_batches([part]) if isinstance(part, pa.RecordBatch) else part)
            n += part.num_rows
        if n >= rows:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()
    else:
        yield from schema.empty_table().to_batches()


def stacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column whose rows have one length as a matrix."""
    values = pc.list_flatten(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.to_numpy(zero_copy_only=False).reshape(len(column), -1)
