"""Rake and compress inside pieces of the node numbers, before the rounds of ``contract`` and the levels of ``fold_levels``.

Nodes are cut into ranges of their numbers. Inside a range everything whose neighbours are there too is contracted in
numpy: finished subtrees go into their parents, chains become one node. Where numbers follow the tree, as positions
do, few nodes of a range are left: those with a parent or an unfinished child elsewhere. Any other numbers give the
same result and leave more to the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.algebra import BatchForm, TreeAlgebra
from ..functions.grouped import group_heads, whole_groups, with_null_lists, without_null_lists
from ..session import discard, materialize, ship_package

#: rows that a task contracts at a time; a state of no more rows goes to the rounds as it is
PIECE = 1 << 17
#: rows of a piece that is only cut to give every core some work
LEAST = 1 << 14

_KEY = ["tree_id", "id"]
#: what a row has taken over; rows that have taken nothing yet go to Python without it
_TAKEN = ["k", "p", "wrapped", "s", "has"]


def contract_pieces(
    state: DataFrame, kids: DataFrame, algebra: TreeAlgebra, total: int, piece: int = PIECE, fresh: bool = False
) -> DataFrame:
    """The state with ``n``, written, as long as a pass over ranges leaves at most half of it.

    ``kids`` has the number ``n`` of children of each parent; it goes with the nodes, so that no join is needed. A
    ``fresh`` state is one in which no row has taken over anything.
    """
    rows, loose = _with_kids(state, kids)
    rows = rows.drop(*_TAKEN) if fresh else rows
    earlier, before = None, total
    while True:
        left = _contracted(rows, algebra, before, piece)
        left = materialize(left if earlier is not None else left.unionByName(loose), "state")
        fresh = False
        if earlier is not None:
            discard(earlier)
        now = left.count()
        if now <= piece or 2 * now > before:
            return left
        earlier, before = left, now
        rows = left.withColumn("kids", F.lit(None).cast("bigint"))


def rake_pieces(nodes: DataFrame, algebra: TreeAlgebra, total: int, piece: int = PIECE) -> DataFrame:
    """``(tree_id, node_id, parent_id, depth, value)`` with ``s`` and ``has``, the product of finished children and whether
    there is any: a subtree inside a range is folded into the parent of its root. Chains stay, and with them all depths."""
    state = nodes.select(
        "tree_id", F.col("node_id").alias("id"), F.col("parent_id").alias("parent"), "depth", F.col("value").alias("a")
    )
    kids = state.filter("parent is not null").groupBy("tree_id", F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    rows, loose = _with_kids(state, kids)
    loose = loose.withColumns({"s": F.lit(None).cast(algebra.result_type), "has": F.lit(False)})
    left = _contracted(rows, algebra, total, piece, compress=False).unionByName(loose, allowMissingColumns=True)
    left = left.withColumnsRenamed({"id": "node_id", "parent": "parent_id", "a": "value"})
    left = materialize(left.select(*[F.col(f.name).cast(f.dataType) for f in nodes.schema.fields], "s", "has", "n"), "raked")
    if not left.filter("n < 0 or (tree_id is null and parent_id is not null)").isEmpty():
        raise ValueError("parent not found")
    return left.drop("n")


def _with_kids(state: DataFrame, kids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of a first pass, and those that take no part: without a number they are nobody's parent."""
    known = F.col("tree_id").isNotNull() & F.col("id").isNotNull()
    loose = state.filter(~known).withColumn("n", F.lit(0).cast("bigint"))
    rows = state.filter(known).withColumns({"n": F.lit(0).cast("bigint"), "kids": F.lit(None).cast("bigint")})
    counts = kids.filter(known).select(*_KEY, F.col("n").alias("kids"))
    return rows.unionByName(counts, allowMissingColumns=True), loose


def _contracted(rows: DataFrame, algebra: TreeAlgebra, total: int, piece: int, compress: bool = True) -> DataFrame:
    form = algebra.batch
    parts = max(-(-total // piece), min(rows.sparkSession.sparkContext.defaultParallelism, total // LEAST), 1)
    rows = rows.repartitionByRange(parts, *_KEY)
    taken = {"k": algebra.result_type, "p": algebra.affine.p_type, "wrapped": T.BooleanType(), "s": algebra.result_type, "has": T.BooleanType()}
    kinds = {f.name: f.dataType for f in rows.drop("kids").schema.fields} | {c: T.LongType() for c in ("tree_id", "id", "parent", "n")}
    if not compress:
        taken = {c: taken[c] for c in ("s", "has")}
    schema = T.StructType([T.StructField(c, t) for c, t in (kinds | taken).items()])

    arrow = to_arrow_schema(schema)

    def contracted(tables: list[pa.Table]) -> pa.RecordBatch:
        batch = contract_table(with_null_lists(pa.concat_tables(tables)), form, compress)
        none = {f.name: pa.nulls(batch.num_rows, f.type) for f in arrow if f.name not in batch.schema.names}
        columns = [none[f.name] if f.name in none else batch.column(f.name).cast(f.type) for f in arrow]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in whole_groups(batches, _KEY):
            held.append(table)
            size += table.num_rows
            if size >= piece:
                yield contracted(held)
                held, size = [], 0
        if size:
            yield contracted(held)

    ship_package(rows.sparkSession)
    rows = rows.withColumns({c: F.col(c).cast("bigint") for c in ("tree_id", "id", "parent")})
    return without_null_lists(rows.sortWithinPartitions(*_KEY)).mapInArrow(run, schema)


def locate(tree: np.ndarray, ids: np.ndarray, parent: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row number of each row's parent, -1 where there is none among the rows; and whether a row has a parent."""
    has = parent.is_valid().to_numpy()
    values, code = np.unique(ids, return_inverse=True)
    groups, group = np.unique(tree, return_inverse=True)
    key = group * len(values) + code
    order = np.argsort(key)
    wanted = parent.fill_null(0).to_numpy()
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    place = np.minimum(np.searchsorted(key, group * len(values) + at, sorter=order), len(key) - 1)
    found = order[place]
    return np.where(has & (ids[found] == wanted) & (tree[found] == tree), found, -1), has


def give(s: np.ndarray, has: np.ndarray, to: np.ndarray, given: np.ndarray, form: BatchForm) -> None:
    """The products ``given`` of finished children go into the rows ``to``, each at most once."""
    both = np.stack([s[to], given], axis=1).reshape(-1, *given.shape[1:])
    s[to] = given
    old = has[to]
    if old.any():
        s[to[old]] = form.mult_runs(both, np.arange(0, len(both), 2))[old]
    has[to] = True


def _heads(rows: np.ndarray, turn: int) -> np.ndarray:
    x = (rows.astype(np.uint64) + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63) == 1


def contract_table(table: pa.Table, form: BatchForm, compress: bool = True) -> pa.RecordBatch:
    """Contract a piece: nodes, and rows with only a number of ``kids``, sorted by tree and node.

    Nodes that are there twice, and contexts that the numpy form does not know, stay as they are; so does what depends
    on them. A NULL value counts as zero. Where there is a ``depth`` it is as in levels: nodes with a NULL value stay, and
    only nodes of the next depth go into a node.
    """
    compress = compress and form.composes
    heads = group_heads(table, _KEY)
    group = np.repeat(np.arange(len(heads)), np.diff(heads, append=table.num_rows))
    kids = table.column("kids")
    node = ~kids.is_valid().to_numpy()
    count = np.add.reduceat(kids.fill_null(0).to_numpy(), heads)
    twice = np.add.reduceat(node.astype(np.int64), heads) > 1
    lost = np.flatnonzero(np.add.reduceat(node.astype(np.int64), heads) == 0)
    lost = {c: table.column(c).take(pa.array(heads[lost])).combine_chunks() for c in _KEY} | {"n": pa.array(np.full(len(lost), -1))}
    group, table = group[node], table.filter(pa.array(node)).drop_columns(["kids"])
    if not table.num_rows:
        return _with_lost({}, lost if "depth" in table.column_names else {})

    n = table.column("n").to_numpy() + count[group]
    col = {c: table.column(c).combine_chunks() for c in table.column_names}
    fresh = "s" not in col
    fixed, a = twice[group], form.from_arrow(col["a"])
    if fresh:
        wrapped, has = np.zeros((2, len(n)), bool)
        k, p, s = np.zeros((3, *a.shape), a.dtype)
    else:
        wrapped, has = (col[c].to_numpy(zero_copy_only=False).copy() for c in ("wrapped", "has"))
        fixed = fixed | wrapped & ~form.knows(col["k"], col["p"])
        s = form.from_arrow(col["s"]).copy()
        k, p = form.contexts(col["k"], col["p"]) if compress else (None, None)
    if "depth" in col:
        fixed |= col["a"].is_null().to_numpy(zero_copy_only=False)
    up, has_parent = locate(col["tree_id"].to_numpy(), col["id"].to_numpy(), table.column("parent"))
    parent = col["parent"].fill_null(0).to_numpy().copy()
    up = np.where((up >= 0) & ~fixed & ~fixed[up], up, -1)
    if "depth" in col:
        depth = col["depth"].cast(pa.int64()).fill_null(-2).to_numpy()
        up = np.where(depth[up] == depth - 1, up, -1)

    alive = np.ones(len(n), bool)
    near, turn = np.flatnonzero(up >= 0), 0
    while True:
        turn += 1
        leaves = near[n[near] == 0]
        if len(leaves):
            leaves = leaves[np.argsort(up[leaves], kind="stable")]
            x = form.hom(a[leaves]).copy()
            inner = np.flatnonzero(has[leaves])
            x[inner] = form.plus(a[leaves[inner]], s[leaves[inner]])
            through = np.flatnonzero(wrapped[leaves])
            if len(through):
                at = leaves[through]
                x[through] = form.through(k[at], p[at], x[through])
            starts = np.flatnonzero(np.diff(up[leaves], prepend=-1))
            to = up[leaves[starts]]
            give(s, has, to, form.mult_runs(x, starts), form)
            n[to] -= np.diff(starts, append=len(leaves))
            alive[leaves] = False
            near = near[alive[near]]
        below = near[(n[up[near]] == 1) & (up[near] != near)] if compress else near[:0]
        if not len(below) and not len(leaves):
            break
        # a node with heads goes into its only unfinished child, unless that goes into its own
        below = below[_heads(up[below], turn) & ~(_heads(below, turn) & (n[below] == 1))]
        if len(below):
            above = up[below]
            uk, u_p = form.of_node(a[above], s[above], has[above])
            both = np.flatnonzero(wrapped[above])
            uk[both], u_p[both] = form.compose(k[above[both]], p[above[both]], uk[both], u_p[both])
            both = np.flatnonzero(wrapped[below])
            uk[both], u_p[both] = form.compose(uk[both], u_p[both], k[below[both]], p[below[both]])
            k[below], p[below], wrapped[below] = uk, u_p, True
            parent[below], has_parent[below], up[below] = parent[above], has_parent[above], up[above]
            alive[above] = False
            near = near[alive[near] & (up[near] >= 0)]

    left = np.flatnonzero(alive)
    rows = pa.array(left)
    out = {c: x.take(rows) for c, x in col.items()}
    out["parent"] = pa.array(parent[left], mask=~has_parent[left])
    if "depth" not in col and col["a"].null_count:
        out["a"] = form.to_arrow(a[left], np.ones(len(left), bool))
    changed = ~fixed[left]
    new = {"s": form.to_arrow(s[left], has[left] & changed)}
    if compress:
        new |= zip("kp", form.context_arrays(k[left], p[left], wrapped[left] & changed))
    out |= {c: x if fresh else _mixed(x, out[c], changed) for c, x in new.items()}
    out |= {c: pa.array(x[left]) for c, x in (("wrapped", wrapped), ("has", has), ("n", n))}
    return _with_lost(out, lost if "depth" in col else {})


def _with_lost(out: dict[str, pa.Array], lost: dict[str, pa.Array]) -> pa.RecordBatch:
    """The rows, and those of parents that are not there: they have a negative ``n``, and are only of use to levels."""
    more = len(lost["n"]) if lost else 0
    if not out:
        out = lost or {c: pa.array([], pa.int64()) for c in [*_KEY, "n"]}
    elif more:
        out = {c: pa.concat_arrays([x, lost[c].cast(x.type) if c in lost else pa.nulls(more, x.type)]) for c, x in out.items()}
    return pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _mixed(new: pa.Array, old: pa.Array, changed: np.ndarray) -> pa.Array:
    """``new`` where rows could change, else ``old``."""
    if changed.all():
        return new
    return pa.chunked_array([new.cast(old.type), old]).combine_chunks().take(
        pa.array(np.where(changed, 0, len(new)) + np.arange(len(new)))
    )
