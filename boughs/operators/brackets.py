"""Brackets of one segment matched in one pass over its tokens: one packed row per segment.

Tokens of a segment are sorted into lanes, one per level, in which opens and closes alternate. Everything is relative
to the depth before the segment, which need not be known yet. A packed row holds the nodes that the segment opens, with
the closes and parents found inside it, and its loose ends: closes of nodes opened earlier and opens without a close.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grouped import group_heads, whole_groups
from ..session import ship_package
from .match import CLOSE, OPEN

_LONG = T.LongType()


def _lists(names: list[str], columns: list[pa.Array], offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names))


def _offsets(chosen: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where the chosen rows of each group begin, and their number."""
    return np.append(np.searchsorted(chosen, heads), len(chosen))


def pack_table(table: pa.Table) -> pa.RecordBatch:
    """Packed rows of whole segments ``(tree_id, c, pos, value)``, sorted by segment and position."""
    heads = group_heads(table, ["tree_id", "c"])
    n = table.num_rows
    pos = table.column("pos").to_numpy()
    is_open = table.column("value").is_valid().to_numpy()
    segment = np.repeat(np.arange(len(heads)), np.diff(heads, append=n))
    step = np.where(is_open, 1, -1)
    run = np.cumsum(step)
    run -= (run[heads] - step[heads])[segment]
    level = run - is_open
    net = run[np.append(heads[1:], n) - 1]
    low = np.minimum.reduceat(np.where(is_open, 0, np.minimum(level, 0)), heads)

    # lanes: the tokens of one level of a segment, in their order
    lane = np.lexsort((level, segment))
    first = np.ones(n, bool)
    first[1:] = (np.diff(segment[lane]) != 0) | (np.diff(level[lane]) != 0)
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    lane_open = is_open[lane]
    closed = np.zeros(n, bool)
    closed[:-1] = lane_open[:-1] & ~first[1:] & ~lane_open[1:]
    close = np.zeros(n, np.int64)
    close[:-1] = pos[lane[1:]]

    # a first child follows its open directly; later siblings share its lane
    behind = np.zeros(n, bool)
    behind[1:] = is_open[:-1] & (segment[1:] == segment[:-1])
    nearest = np.maximum.accumulate(np.where(lane_open & behind[lane], np.arange(n), -1))
    inside = nearest >= begin
    parent = pos[lane[np.where(inside, nearest, 0)]] - 1

    back = np.empty(n, np.int64)
    back[lane] = np.arange(n)
    opens = np.flatnonzero(is_open)
    at = back[opens]
    nodes = [
        pa.array(pos[opens]),
        pa.array(close[at], mask=~closed[at]),
        pa.array(parent[at], mask=~inside[at]),
        pa.array(level[opens].astype(np.int64)),
        table.column("value").combine_chunks().take(pa.array(opens)),
    ]
    loose = np.flatnonzero(np.where(is_open, ~closed[back], first[back]))
    ends = [
        pa.array(level[loose].astype(np.int64)),
        pa.array(np.where(is_open[loose], OPEN, CLOSE).astype(np.int32)),
        pa.array(pos[loose]),
    ]
    columns = [
        table.column("tree_id").combine_chunks().take(pa.array(heads)),
        table.column("c").combine_chunks().take(pa.array(heads)),
        pa.array(net.astype(np.int64)),
        pa.array(low.astype(np.int64)),
        _lists(["level", "kind", "pos"], ends, _offsets(loose, heads)),
        _lists(["pos", "close_here", "parent_here", "level", "value"], nodes, _offsets(opens, heads)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["tree_id", "c", "net", "low", "loose", "nodes"])


def pack_segments(tokens: DataFrame, segment_bits: int) -> DataFrame:
    """``(tree_id, pos, value)`` -> ``(tree_id, c, net, low, loose, nodes)``; a task holds one segment and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["tree_id", "c"]):
            yield pack_table(table)

    ship_package(tokens.sparkSession)
    kinds = {f.name: f.dataType for f in tokens.schema.fields}

    def rows(*fields: tuple[str, T.DataType]) -> T.ArrayType:
        return T.ArrayType(T.StructType([T.StructField(*f) for f in fields]))

    schema = T.StructType(
        [
            T.StructField("tree_id", kinds["tree_id"]),
            *[T.StructField(c, _LONG) for c in ("c", "net", "low")],
            T.StructField("loose", rows(("level", _LONG), ("kind", T.IntegerType()), ("pos", _LONG))),
            T.StructField(
                "nodes",
                rows(("pos", _LONG), ("close_here", _LONG), ("parent_here", _LONG), ("level", _LONG), ("value", kinds["value"])),
            ),
        ]
    )
    cut = tokens.select("tree_id", F.shiftright(F.col("pos").cast("bigint"), segment_bits).alias("c"), F.col("pos").cast("bigint"), "value")
    return cut.repartition("tree_id", "c").sortWithinPartitions("tree_id", "c", "pos").mapInArrow(run, schema)
