"""Fold by rake and compress: a number of rounds that is logarithmic in the tree size, at any height.

A row is a node ``a`` with the product ``s`` of its finished children (``has``: any yet?), ``n`` unfinished
children, and an optional context ``x -> k (+) p (*) x`` (``wrapped``) that its value still goes through
because it took over ancestors. A round

* rakes: all nodes without unfinished children hand their value to their parents, combined on the map side;
* compresses: of a chain of nodes with one unfinished child each, a random part is taken over by the only
  child, so that a chain loses a quarter of its nodes per round on average.

Trees that are down to ``SMALL`` rows, which the loop checks, are finished by one task per group of trees. A state of
more than ``PIECE`` rows is first contracted inside ranges of node numbers (``pieces.py``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.algebra import BatchForm, TreeAlgebra
from ..functions.grouped import whole_groups, with_null_lists, without_null_lists
from ..operators.skew import spread_join
from ..session import discard, materialize, ship_package
from .pieces import PIECE, contract_pieces, give, locate

SMALL = 50_000

_STATE = ["tree_id", "id", "parent", "k", "p", "wrapped", "a", "s", "has"]


def check_parents(nodes: DataFrame) -> None:
    """Raise if a node names a parent that its tree does not have. Wide families are one row of the check."""
    parents = nodes.filter(F.col("parent_id").isNotNull()).select("tree_id", "parent_id").distinct()
    ids = nodes.select("tree_id", F.col("node_id").alias("parent_id"))
    if not parents.join(ids, ["tree_id", "parent_id"], "left_anti").isEmpty():
        raise ValueError("parent not found")


def fold_rounds(nodes: DataFrame, algebra: TreeAlgebra, small: int = SMALL, piece: int = PIECE) -> DataFrame:
    """Flat node set ``(tree_id, node_id, parent_id, value)`` -> ``(tree_id, value)``, any height.

    Raises for a missing parent and for a cycle, whatever the size of the tree.
    """
    affine = algebra.need_affine("fold_rounds")
    check_parents(nodes)
    state = nodes.select(
        "tree_id",
        F.col("node_id").alias("id"),
        F.col("parent_id").alias("parent"),
        F.lit(None).cast(algebra.result_type).alias("k"),
        F.lit(None).cast(affine.p_type).alias("p"),
        F.lit(False).alias("wrapped"),
        F.col("value").alias("a"),
        F.lit(None).cast(algebra.result_type).alias("s"),
        F.lit(False).alias("has"),
    )
    roots = contract(state, algebra, small, piece, fresh=True)
    value = algebra.column.agg(F.col("v")).alias("value")
    return roots.groupBy("tree_id").agg(value).select("tree_id", algebra.answer(F.col("value")).alias("value"))


def _value(algebra: TreeAlgebra) -> Column:
    x = algebra.node_value(F.col("a"), F.col("s"), F.col("has"))
    return F.when(F.col("wrapped"), algebra.affine.apply(F.col("k"), F.col("p"), x)).otherwise(x)


def contract(state: DataFrame, algebra: TreeAlgebra, small: int = SMALL, piece: int = PIECE, fresh: bool = False) -> DataFrame:
    """Root results ``(tree_id, v)`` of the trees in ``state``; in a ``fresh`` one no row has taken over anything."""
    algebra.need_affine("contract")
    state = materialize(state.select(*_STATE), "state")
    sizes = materialize(state.groupBy("tree_id").count(), "sizes")
    largest, total = sizes.agg(F.max("count"), F.sum("count")).first()
    if (largest or 0) <= small:
        return _finish(state, algebra)

    # small trees are done at once; only the large ones go through the rounds
    sized = spread_join(state, sizes.select("tree_id", F.col("count").alias("size")), ["tree_id"], F.col("id"))
    done = [_finish(sized.filter(F.col("size") <= small).drop("size"), algebra)]
    state = sized.filter(F.col("size") > small).drop("size")
    kids = state.filter("parent is not null").groupBy("tree_id", F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    if algebra.batch is not None and total > piece:
        state = contract_pieces(state, kids, algebra, total, piece, fresh)
    else:
        state = materialize(state.join(kids, ["tree_id", "id"], "left").na.fill(0, ["n"]), "state")
    turn, before = 0, None
    while True:
        largest, total = state.groupBy("tree_id").count().agg(F.max("count"), F.sum("count")).first()
        if (largest or 0) <= small:
            break
        if total == before:
            raise ValueError("the input has a cycle")
        before, turn = total, turn + 1
        leaves = state.filter("n = 0").select("tree_id", "parent", _value(algebra).alias("v"))
        # finished roots are written, so that no earlier state is needed
        done.append(materialize(leaves.filter("parent is null").select("tree_id", "v"), "roots"))
        earlier, raked = state, _rake(state, leaves, algebra)
        discard(earlier)
        state = _compress(raked, algebra, turn)
        discard(raked)
    done.append(_finish(state.select(*_STATE), algebra))
    return reduce(DataFrame.unionAll, done)


def _rake(state: DataFrame, leaves: DataFrame, algebra: TreeAlgebra) -> DataFrame:
    form = algebra.column
    given = (
        leaves.filter("parent is not null")
        .groupBy("tree_id", F.col("parent").alias("id"))
        .agg(form.agg(F.col("v")).alias("gv"), F.count("*").alias("gn"))
    )
    rows = state.filter("n > 0").join(given, ["tree_id", "id"], "left")
    got = F.col("gn").isNotNull()
    s = F.when(got & F.col("has"), form.mult(F.col("s"), F.col("gv"))).when(got, F.col("gv")).otherwise(F.col("s"))
    rows = rows.select(
        "tree_id", "id", "parent", "k", "p", "wrapped", "a", s.alias("s"), (F.col("has") | got).alias("has"),
        (F.col("n") - F.coalesce("gn", F.lit(0))).alias("n"),
    )
    return materialize(rows, "raked")


def _compress(state: DataFrame, algebra: TreeAlgebra, turn: int) -> DataFrame:
    affine = algebra.affine

    def head(tree: str, node: str, n: str) -> Column:
        return (F.col(n) == 1) & (F.pmod(F.xxhash64(tree, node, F.lit(turn)), F.lit(2)) == 0)

    # the only unfinished child, found by an aggregate: a join on the parent would gather wide families
    only = state.filter("parent is not null").groupBy("tree_id", F.col("parent").alias("id")).agg(
        F.min("id").alias("child"), F.max("n").alias("child_n")
    )
    k, p = affine.of_node(F.col("a"), F.when(F.col("has"), F.col("s")))
    upper = state.filter(head("tree_id", "id", "n")).join(only, ["tree_id", "id"])
    upper = upper.filter(~head("tree_id", "child", "child_n")).select(
        "tree_id", "id", "parent", "child", "wrapped",
        F.col("k").alias("wk"), F.col("p").alias("wp"), k.alias("nk"), p.alias("np"),
    )
    wk, wp = affine.compose(F.col("wk"), F.col("wp"), F.col("nk"), F.col("np"))
    upper = upper.select(
        "tree_id",
        F.col("child").alias("id"),
        F.col("id").alias("u_id"),
        F.col("parent").alias("u_parent"),
        F.when(F.col("wrapped"), wk).otherwise(F.col("nk")).alias("uk"),
        F.when(F.col("wrapped"), wp).otherwise(F.col("np")).alias("up"),
    )
    # nodes that go, at most a quarter of the state: written, since both their removal and their children read them
    upper = materialize(upper, "upper")
    gone = upper.select("tree_id", F.col("u_id").alias("id"))
    rows = state.join(gone, ["tree_id", "id"], "left_anti").join(upper, ["tree_id", "id"], "left")
    takes = F.col("u_id").isNotNull()
    ck, cp = affine.compose(F.col("uk"), F.col("up"), F.col("k"), F.col("p"))
    rows = rows.select(
        "tree_id",
        "id",
        F.when(takes, F.col("u_parent")).otherwise(F.col("parent")).alias("parent"),
        F.when(takes & F.col("wrapped"), ck).when(takes, F.col("uk")).otherwise(F.col("k")).alias("k"),
        F.when(takes & F.col("wrapped"), cp).when(takes, F.col("up")).otherwise(F.col("p")).alias("p"),
        (F.col("wrapped") | takes).alias("wrapped"),
        "a",
        "s",
        "has",
        "n",
    )
    rows = materialize(rows, "state")
    discard(upper)
    return rows


def parent_rows(tree: np.ndarray, ids: np.ndarray, parent: pa.ChunkedArray) -> np.ndarray:
    """Row number of each row's parent, -1 for roots."""
    found, has = locate(tree, ids, parent)
    if (has & (found < 0)).any():
        raise ValueError("parent not found")
    return found


def levels_by_jumps(parent: np.ndarray) -> np.ndarray:
    """Level of each row by pointer jumping: the distances double in every step. Raises for a cycle."""
    root = parent < 0
    jump = np.where(root, np.arange(len(parent)), parent)
    level = (~root).astype(np.int64)
    for _ in range(len(parent).bit_length() + 1):
        if root[jump].all():
            return level
        level += level[jump]
        jump = jump[jump]
    raise ValueError("the input has a cycle")


def _fold_by_level(table: pa.Table, parent: np.ndarray, level: np.ndarray, form: BatchForm) -> tuple[np.ndarray, pa.Array]:
    """Rows of the roots and their values: one numpy step per level, deepest first, for all trees of the table."""
    col = {c: table.column(c).combine_chunks() for c in ("k", "p", "a", "s")}
    a, s = form.from_arrow(col["a"]), form.from_arrow(col["s"]).copy()
    has, wrapped = (table.column(c).to_numpy().copy() for c in ("has", "wrapped"))
    order = np.lexsort((parent, -level))
    edges = np.append(np.flatnonzero(np.diff(level[order], prepend=-1)), len(order))
    for lo, hi in zip(edges, edges[1:]):
        rows = order[lo:hi]
        x = form.hom(a[rows]).copy()
        inner = np.flatnonzero(has[rows])
        x[inner] = form.plus(a[rows[inner]], s[rows[inner]])
        through = np.flatnonzero(wrapped[rows])
        if len(through):
            at = pa.array(rows[through])
            x[through] = form.apply(col["k"].take(at), col["p"].take(at), x[through])
        if level[rows[0]] == 0:
            return rows, form.to_arrow(x, np.ones(len(x), bool))
        starts = np.flatnonzero(np.diff(parent[rows], prepend=-1))
        up, given = parent[rows[starts]], form.mult_runs(x, starts)
        give(s, has, up, given, form)
    raise AssertionError("unreachable")


def _fold_by_row(table: pa.Table, parent: np.ndarray, algebra: TreeAlgebra) -> tuple[np.ndarray, pa.Array]:
    """The same with the scalar functions: user algebras, and trees about as tall as they have rows."""
    hom, plus, mult, apply = algebra.hom, algebra.plus, algebra.mult, algebra.affine.apply_value
    col = {c: table.column(c).to_pylist() for c in ("k", "p", "wrapped", "a", "s", "has")}
    s, has = col["s"], col["has"]
    waiting = np.bincount(parent[parent >= 0], minlength=len(parent)).tolist()
    ready, up, roots, out = [i for i, w in enumerate(waiting) if w == 0], parent.tolist(), [], []
    while ready:
        i = ready.pop()
        x = plus(col["a"][i], s[i]) if has[i] else hom(col["a"][i])
        if col["wrapped"][i]:
            x = apply(col["k"][i], col["p"][i], x)
        p = up[i]
        if p < 0:
            roots.append(i)
            out.append(x)
            continue
        s[p] = mult(s[p], x) if has[p] else x
        has[p] = True
        waiting[p] -= 1
        if not waiting[p]:
            ready.append(p)
    return np.array(roots, np.int64), pa.array(out, to_arrow_type(algebra.result_type))


def _finish(state: DataFrame, algebra: TreeAlgebra) -> DataFrame:
    """Fold trees of at most ``SMALL`` rows, whole trees per batch."""

    def fold(table: pa.Table) -> pa.RecordBatch:
        tree = table.column("tree_id").to_numpy()
        parent = parent_rows(tree, table.column("id").to_numpy(), table.column("parent"))
        level = levels_by_jumps(parent)
        # a numpy step costs about as much as 64 scalar ones
        if algebra.batch is not None and int(level.max()) * 64 < len(level) + 4096:
            rows, values = _fold_by_level(table, parent, level, algebra.batch)
        else:
            rows, values = _fold_by_row(table, parent, algebra)
        return pa.RecordBatch.from_arrays([pa.array(tree[rows], pa.int64()), values], ["tree_id", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["tree_id"]):
            yield fold(with_null_lists(table))

    ship_package(state.sparkSession)
    rows = state.withColumn("tree_id", F.col("tree_id").cast("bigint"))
    rows = without_null_lists(rows.repartition("tree_id").sortWithinPartitions("tree_id"))
    schema = T.StructType([T.StructField("tree_id", T.LongType()), T.StructField("v", algebra.result_type)])
    return rows.mapInArrow(run, schema)
