"""Arrow batches regrouped so that each table holds whole groups of a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def group_heads(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group of BIGINT ``keys`` begins."""
    change = np.zeros(table.num_rows, dtype=bool)
    change[:1] = True
    for k in keys:
        x = table.column(k).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Keep back the last group of each batch, which may go on in the next one.

    Rows must be sorted by ``keys`` and groups must have a size bound: only one group is ever held back.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        table = pa.Table.from_batches([*held, b])
        last = int(group_heads(table, keys)[-1])
        if last:
            yield table.slice(0, last)
        held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def without_null_lists(rows: DataFrame) -> DataFrame:
    """NULL arrays as empty ones, for the way to Python: Spark sizes its batch after every row, and a list vector then
    walks over the NULLs at its end, so long runs of them cost their square. No array may be empty otherwise."""
    lists = [f for f in rows.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return rows.withColumns({f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in lists}) if lists else rows


def with_null_lists(table: pa.Table) -> pa.Table:
    """Undo ``without_null_lists``."""
    for i, f in enumerate(table.schema):
        if pa.types.is_list(f.type):
            x = table.column(i).combine_chunks()
            full = pc.greater(pc.list_value_length(x), 0)
            table = table.set_column(i, f.name, pc.if_else(full, x, pa.scalar(None, x.type)))
    return table
