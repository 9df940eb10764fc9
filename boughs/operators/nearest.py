"""All nearest smaller values over one row per chunk, with no group that grows with a tree.

For every row ``m`` of a sequence: the last row before it with a smaller value, and the first row after it whose value is
no larger. Both together are the pair of rows that see each other over ``m``. A sequence of n rows has fewer than n
such pairs besides its n - 1 neighbours, however deep its values climb.

A block of ``2**bits`` order numbers is one stack pass inside a task. What a block cannot answer are its prefix minima
(nothing smaller before them) and its suffix minima (nothing as small after them). The same operator on the blocks' minima
yields the pairs of blocks that see each other, again fewer than two per block, and each pair of blocks answers
the minima that lie between the two and what separates them by sorted search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grouped import group_heads, whole_groups
from ..session import materialize, ship_package
from .scan import BLOCK_BITS
from .skew import spread_join

#: pairs of blocks that may share one block before that block is copied
HOT_PAIRS = 1 << 10

_PAIR = ["k", "dk", "r", "dr", "hi"]
_LOOSE = ["c", "d", "lc", "ld", "rc", "rd"]
_ENDS = ["first_c", "first_d", "last_c", "last_d", "low"]


def _fields(names: list[str], mark: str = " ") -> str:
    return ", ".join(f"{n}{mark}bigint" for n in names)


def _stack_pass(values: list[int], left: np.ndarray, right: np.ndarray, start: int) -> None:
    """Fill the places of the nearest smaller values of one block; -1 where the block has none."""
    stack: list[int] = []
    before, after = [-1] * len(values), [-1] * len(values)
    for i, x in enumerate(values):
        while stack and values[stack[-1]] >= x:
            after[stack.pop()] = start + i
        if stack:
            before[i] = start + stack[-1]
        stack.append(i)
    left[start : start + len(values)] = before
    right[start : start + len(values)] = after


def _lists(group: np.ndarray, n_groups: int, names: list[str], columns: list[pa.Array]) -> pa.ListArray:
    """Rows of ``columns`` as one list of structs per group."""
    order = pa.array(np.argsort(group, kind="stable"))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=n_groups))]).astype(np.int32)
    items = pa.StructArray.from_arrays([x.take(order) for x in columns], names)
    return pa.ListArray.from_arrays(pa.array(offsets), items)


def _at(x: np.ndarray, place: np.ndarray) -> pa.Array:
    """Values at ``place``, NULL where the place is -1."""
    return pa.array(x[place], mask=place < 0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["tree_id", "blk"]):
        heads = group_heads(table, ["tree_id", "blk"])
        c, d = table.column("c").to_numpy(), table.column("d").to_numpy()
        ends = np.append(heads[1:], len(c))
        left, right = np.empty(len(c), np.int64), np.empty(len(c), np.int64)
        for a, b in zip(heads.tolist(), ends.tolist()):
            _stack_pass(d[a:b].tolist(), left, right, a)
        group = np.repeat(np.arange(len(heads)), ends - heads)

        near = np.flatnonzero(group[1:] == group[:-1])
        wide = np.flatnonzero((left >= 0) & (right >= 0))
        k, r = np.concatenate([near, left[wide]]), np.concatenate([near + 1, right[wide]])
        over = np.concatenate([np.full(len(near), -1), wide])
        pairs = [pa.array(c[k]), pa.array(d[k]), pa.array(c[r]), pa.array(d[r]), _at(d, over)]
        loose = np.flatnonzero((left < 0) | (right < 0))
        halves = [_at(x, place) for place in (left[loose], right[loose]) for x in (c, d)]
        columns = [
            *[table.column(n).combine_chunks().take(pa.array(heads)) for n in ("tree_id", "blk")],
            *[pa.array(x) for x in (c[heads], d[heads], c[ends - 1], d[ends - 1], np.minimum.reduceat(d, heads))],
            _lists(group[k], len(heads), _PAIR, pairs),
            _lists(group[loose], len(heads), _LOOSE, [pa.array(c[loose]), pa.array(d[loose]), *halves]),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["tree_id", "blk", *_ENDS, "pairs", "loose"])


def _minima(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    items = cell.values
    return items.field("c").to_numpy(), items.field("d").to_numpy()


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks ``(dk, dr, hi, ups, downs)`` -> halves found for the minima of either block."""
    for b in batches:
        rows = []
        edges = zip(*(b.column(n).to_pylist() for n in ("tree_id", "dk", "dr", "hi")))
        for i, (tree, dk, dr, hi) in enumerate(edges):
            (up_c, up_d), (down_c, down_d) = _minima(b.column("ups")[i]), _minima(b.column("downs")[i])
            # ups rise to the right, downs fall: the last smaller one, and the first one that is no larger
            asks = (down_d > dk) if hi is None else (down_d > dk) & (down_d <= hi)
            found = np.searchsorted(up_d, down_d[asks], "left") - 1
            n, none = len(found), np.full(len(found), -1)
            rows.append((tree, n, down_c[asks], down_d[asks], _at(up_c, found), _at(up_d, found), _at(none, none), _at(none, none)))
            asks = (up_d >= dr) if hi is None else (up_d >= dr) & (up_d < hi)
            found = np.searchsorted(-down_d, -up_d[asks], "left")
            n, none = len(found), np.full(len(found), -1)
            rows.append((tree, n, up_c[asks], up_d[asks], _at(none, none), _at(none, none), _at(down_c, found), _at(down_d, found)))
        if not rows:
            continue
        tree = np.repeat(np.array([r[0] for r in rows], np.int64), [r[1] for r in rows])
        columns = [pa.concat_arrays([pa.array(r[i], pa.int64()) for r in rows]) for i in range(2, 8)]
        yield pa.RecordBatch.from_arrays([pa.array(tree), *columns], names=["tree_id", *_LOOSE])


def visible_pairs(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """``(tree_id, c, d)`` -> ``(tree_id, k, dk, r, dr, hi)``: the rows that see each other over higher ones.

    ``c`` is a non-negative order number, unique per tree, ``d`` the value there. Neighbours have a NULL ``hi``. For all
    other pairs ``hi`` is the lowest value between them, above ``dk`` and at least ``dr``. All columns are BIGINT.
    Empty input gives no row.
    """
    spark = rows.sparkSession
    ship_package(spark)
    rows = rows.select("tree_id", F.col("c").cast("bigint").alias("c"), F.col("d").cast("bigint").alias("d"))
    rows = rows.withColumn("blk", F.shiftright("c", bits)).repartition("tree_id", "blk")
    rows = rows.sortWithinPartitions("tree_id", "blk", "c")
    lists = [f"{name} array<struct<{_fields(of, ':')}>>" for name, of in (("pairs", _PAIR), ("loose", _LOOSE))]
    packed = materialize(rows.mapInArrow(_blocks, ", ".join([_fields(["tree_id", "blk", *_ENDS]), *lists])), "blocks")
    inside = packed.select("tree_id", F.inline("pairs"))
    if not packed.agg(F.max("blk")).first()[0]:
        return inside

    outer = visible_pairs(packed.select("tree_id", F.col("blk").alias("c"), F.col("low").alias("d")), bits)
    outer = materialize(outer, "block-pairs")
    open_right = F.transform(F.filter("loose", lambda x: x["rc"].isNull()), lambda x: F.struct(x["c"], x["d"]))
    open_left = F.transform(F.filter("loose", lambda x: x["lc"].isNull()), lambda x: F.struct(x["c"], x["d"]))
    hi = F.col("hi")
    left = packed.select("tree_id", F.col("blk").alias("k"), open_right.alias("ups"))
    seen = spread_join(outer, left, ["tree_id", "k"], F.col("r"), HOT_PAIRS)
    seen = seen.withColumn("ups", F.filter("ups", lambda x: hi.isNull() | (x["d"] < hi)))
    right = packed.select("tree_id", F.col("blk").alias("r"), open_left.alias("downs"))
    seen = spread_join(seen, right, ["tree_id", "r"], F.col("k"), HOT_PAIRS)
    asked = seen.select("tree_id", "dk", "dr", "hi", "ups", "downs")
    found = asked.mapInArrow(_across, _fields(["tree_id", *_LOOSE]))

    halves = packed.select("tree_id", F.inline("loose")).unionAll(found)
    whole = halves.groupBy("tree_id", "c").agg(*[F.max(n).alias(n) for n in _LOOSE[1:]])
    whole = whole.filter("lc is not null and rc is not null").select(
        "tree_id", F.col("lc").alias("k"), F.col("ld").alias("dk"), F.col("rc").alias("r"), F.col("rd").alias("dr"),
        F.col("d").alias("hi"),
    )
    firsts = packed.select("tree_id", F.col("blk").alias("r"), "first_c", "first_d")
    lasts = packed.select("tree_id", F.col("blk").alias("k"), "last_c", "last_d")
    near = outer.filter("hi is null").select("tree_id", "k", "r").join(lasts, ["tree_id", "k"]).join(firsts, ["tree_id", "r"])
    near = near.select(
        "tree_id", F.col("last_c").alias("k"), F.col("last_d").alias("dk"), F.col("first_c").alias("r"),
        F.col("first_d").alias("dr"), F.lit(None).cast("bigint").alias("hi"),
    )
    return inside.unionAll(near).unionAll(whole)
