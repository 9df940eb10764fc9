"""Chunk partials and their ordered merge.

``chunk_partial`` is a map-only job: each chunk row becomes a small partial before anything is shuffled.
``merge_partials`` joins neighbours in rounds of ``fan_in``, so no task ever sees more than ``fan_in``
partials at once, whatever the size of the tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.algebra import TreeAlgebra
from ..functions.fold_events import CLOSE, OPEN, Events, Partials, fold_events
from ..functions.grouped import group_heads, whole_groups
from ..session import ship_package

FAN_IN = 256

#: Tokens, or entries of partials, that a Python step holds at once; a larger chunk or group is a step of its own.
STEP_ENTRIES = 1 << 17


def partial_schema(algebra: TreeAlgebra) -> T.StructType:
    v, has = T.StructField("v", algebra.result_type), T.StructField("has", T.BooleanType())
    a = T.StructField("a", algebra.value_type)
    return T.StructType(
        [
            T.StructField("tree_id", T.LongType()),
            T.StructField("chunk_id", T.LongType()),
            T.StructField("cs", T.ArrayType(T.StructType([v, has]))),
            T.StructField("abs", T.ArrayType(T.StructType([a, v, has]))),
        ]
    )


def _types(algebra: TreeAlgebra) -> tuple[pa.DataType, pa.DataType]:
    return to_arrow_type(algebra.value_type), to_arrow_type(algebra.result_type)


def _list_array(offsets: np.ndarray, items: pa.Array) -> pa.ListArray:
    if offsets[-1] >= 1 << 31:
        raise OverflowError("a batch holds 2**31 entries; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items)


def _batch(tree_id: pa.Array, chunk_id: pa.Array, p: Partials) -> pa.RecordBatch:
    cs = pa.StructArray.from_arrays([p.cs_v, pa.array(p.cs_has)], ["v", "has"])
    opens = pa.StructArray.from_arrays([p.open_a, p.open_v, pa.array(p.open_has)], ["a", "v", "has"])
    return pa.RecordBatch.from_arrays(
        [
            tree_id,
            chunk_id,
            _list_array(p.cs_offsets, cs),
            _list_array(p.open_offsets, opens),
        ],
        ["tree_id", "chunk_id", "cs", "abs"],
    )


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), column.flatten()


def bounded_runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows whose ``sizes`` add up to at most ``limit``, or of one row."""
    ends, lo, before = np.cumsum(sizes), 0, 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield lo, hi
        lo, before = hi, int(ends[hi - 1])


def chunk_partial(chunks: DataFrame, algebra: TreeAlgebra) -> DataFrame:
    """Token chunks ``(tree_id, chunk_id, tokens)`` -> partials ``(tree_id, chunk_id, cs, abs)``."""
    a_type, v_type = _types(algebra)

    def fold(b: pa.RecordBatch) -> pa.RecordBatch:
        offsets, tokens = _lists(b.column(2))
        close = pc.equal(tokens, "/")
        kind = np.where(close.to_numpy(zero_copy_only=False), CLOSE, OPEN).astype(np.int8)
        texts = pc.if_else(close, pa.scalar(None, tokens.type), tokens)
        if algebra.batch is not None:
            values = algebra.batch.decode(texts)
        else:
            values = [None if t is None else algebra.parse(t) for t in texts.to_pylist()]
        return _batch(b.column(0), b.column(1), fold_events(Events(kind, values, offsets), algebra, a_type, v_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.list_value_length(b.column(2)).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi in bounded_runs(sizes, STEP_ENTRIES):
                # a copy: pyarrow 23 computes if_else wrongly over sliced texts
                yield fold(b.take(pa.array(np.arange(lo, hi))))

    ship_package(chunks.sparkSession)
    rows = chunks.select(F.col("tree_id").cast("bigint"), F.col("chunk_id").cast("bigint"), "tokens")
    return rows.mapInArrow(run, partial_schema(algebra))


def _events_of_partials(table: pa.Table, algebra: TreeAlgebra) -> tuple[Events, np.ndarray]:
    """Partials as event runs (one per row). Returns the events and the event count of each row."""
    cs_off, cs = _lists(table.column("cs").combine_chunks())
    op_off, op = _lists(table.column("abs").combine_chunks())
    n_cs, n_op = np.diff(cs_off), np.diff(op_off)
    start = np.concatenate([[0], np.cumsum(2 * (n_cs + n_op))])
    n = int(start[-1])
    kind = np.zeros(n, dtype=np.int8)
    keep = np.ones(n, dtype=bool)

    # finished values run from deep to shallow, with a close between two of them
    row = np.repeat(np.arange(len(n_cs)), n_cs)
    turn = np.arange(len(row)) - cs_off[:-1][row]
    source = cs_off[1:][row] - 1 - turn
    value_at = start[:-1][row] + 2 * turn
    cs_has = cs.field("has").to_numpy(zero_copy_only=False)[source]
    keep[value_at] = cs_has
    kind[value_at + 1] = CLOSE
    keep[value_at + 1] = turn < n_cs[row] - 1

    row = np.repeat(np.arange(len(n_op)), n_op)
    turn = np.arange(len(row)) - op_off[:-1][row]
    open_at = (start[:-1] + 2 * n_cs)[row] + 2 * turn
    kind[open_at] = OPEN
    op_has = op.field("has").to_numpy(zero_copy_only=False)
    keep[open_at + 1] = op_has

    if algebra.batch is not None:
        form = algebra.batch
        cs_v, op_a = form.from_arrow(cs.field("v")), form.from_arrow(op.field("a"))
        values = np.zeros((n, *cs_v.shape[1:]), dtype=cs_v.dtype)
        values[value_at] = cs_v[source]
        values[open_at], values[open_at + 1] = op_a, form.from_arrow(op.field("v"))
        values = values[keep]
    else:
        values = [None] * n
        for at, x in zip(value_at.tolist(), cs.field("v").take(pa.array(source)).to_pylist()):
            values[at] = x
        for at, a, v in zip(open_at.tolist(), op.field("a").to_pylist(), op.field("v").to_pylist()):
            values[at], values[at + 1] = a, v
        values = [x for x, k in zip(values, keep.tolist()) if k]
    kept = np.concatenate([[0], np.cumsum(keep)])
    counts = kept[start[1:]] - kept[start[:-1]]
    return Events(kind[keep], values, np.concatenate([[0], np.cumsum(counts)])), counts


def _merge_round(partials: DataFrame, algebra: TreeAlgebra, fan_in: int) -> DataFrame:
    a_type, v_type = _types(algebra)
    names = ["tree_id", "chunk_id", "cs", "abs"]

    def merge(table: pa.Table, heads: np.ndarray) -> pa.RecordBatch:
        ev, counts = _events_of_partials(table, algebra)
        ends = np.append(heads[1:], len(counts))
        row_offsets = np.concatenate([[0], np.cumsum(counts)])
        offsets = np.append(row_offsets[heads], row_offsets[ends[-1]])
        merged = fold_events(Events(ev.kind, ev.values, offsets), algebra, a_type, v_type)
        at = pa.array(heads)
        return _batch(
            table.column("tree_id").combine_chunks().take(at), table.column("blk").combine_chunks().take(at), merged
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["tree_id", "blk"]):
            heads = group_heads(table, ["tree_id", "blk"])
            entries = sum(pc.list_value_length(table.column(c)).fill_null(0).to_numpy() for c in ("cs", "abs"))
            ends = np.append(heads, table.num_rows)
            for lo, hi in bounded_runs(np.add.reduceat(entries, heads), STEP_ENTRIES):
                yield merge(table.slice(ends[lo], ends[hi] - ends[lo]), heads[lo:hi] - heads[lo])

    ship_package(partials.sparkSession)
    rows = partials.select(*names, F.expr(f"chunk_id div {fan_in}").alias("blk"))
    rows = rows.repartition("tree_id", "blk").sortWithinPartitions("tree_id", "blk", "chunk_id")
    return rows.mapInArrow(run, partial_schema(algebra))


def merge_partials(partials: DataFrame, algebra: TreeAlgebra, max_chunk_id: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge neighbouring partials in rounds until each tree has one. ``chunk_id`` gives the order."""
    while max_chunk_id > 0:
        partials = _merge_round(partials, algebra, fan_in)
        max_chunk_id //= fan_in
    return partials


def chunk_shape(partials: DataFrame) -> DataFrame:
    return partials.select("tree_id", "chunk_id", F.size("cs").alias("n_cs"), F.size("abs").alias("n_abs"))


def partial_value(algebra: TreeAlgebra) -> Column:
    """Answer held by the only partial of a tree; raises for unbalanced input."""
    bad = (F.size("cs") != 1) | (F.size("abs") != 0)
    unbalanced = F.raise_error("unbalanced tree: extra close or unclosed open")
    return F.when(bad, unbalanced).otherwise(algebra.answer(F.col("cs")[0]["v"]))
