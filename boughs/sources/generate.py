"""Random trees, generated in parallel inside one tree as well as over many trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrix
from ..functions.algebra import max_path_sum, path_automaton
from ..operators.scan import exclusive_scan
from ..operators.shape import SEGMENT_BITS
from ..session import materialize, ship_package
from .text import token_text

_OUTER_BITS = 20
#: segments of tokens that a task makes, about 2**20 tokens
_TASK_SEGMENTS = 64
#: 32-bit mixing of the coordinates of a random draw; small factors, so that 64-bit arithmetic never overflows
_WORD = 1 << 32
_FACTORS = (0x2545F491, 0x045D9F3B, 0x1B873593)


def _mix(x):
    """The same steps on a numpy array of UINT64 (below) and, as ``_mix_column``, on a BIGINT column."""
    a, b, _ = map(np.uint64, _FACTORS)
    mask, half, less = np.uint64(_WORD - 1), np.uint64(16), np.uint64(15)
    x = x & mask
    x = ((x ^ (x >> half)) * b) & mask
    x = ((x ^ (x >> less)) * a) & mask
    return x ^ (x >> half)


def _mix_column(x: Column) -> Column:
    a, b, _ = _FACTORS
    x = F.pmod(x, F.lit(_WORD))
    x = (x.bitwiseXOR(F.shiftright(x, 16)) * b) % _WORD
    x = (x.bitwiseXOR(F.shiftright(x, 15)) * a) % _WORD
    return x.bitwiseXOR(F.shiftright(x, 16))


def _coins(tree_id: int, seed: int, k: np.ndarray, deepness: float) -> np.ndarray:
    """Repeatable coins: a task that runs again gives the same tree."""
    a, b, c = _FACTORS
    base = np.uint64((tree_id % (1 << 31)) * a % _WORD + (seed % _WORD) * b % _WORD)
    k = k.astype(np.uint64)
    return _mix(base + (k >> np.uint64(32)) * np.uint64(c) + k) < np.uint64(int(deepness * _WORD))


def unit_element(*keys: Column) -> Column:
    return F.lit(1).cast("bigint")


def matrix_element(*keys: Column) -> Column:
    """Random boolean 10 x 10 matrix as ten row masks, from ``(tree, seed, place)``."""
    a, b, c = _FACTORS
    tree, seed, place = keys
    base = F.pmod(tree, F.lit(1 << 31)) * a % _WORD + F.pmod(seed, F.lit(_WORD)) * b % _WORD
    base = base + F.shiftright(place, 32) * c + F.pmod(place, F.lit(_WORD))
    return F.array(
        *[(_mix_column(base + F.lit((i + 1) * c)) % (1 << matrix.SIZE)).cast("int") for i in range(matrix.SIZE)]
    )


def _matrix_values(seed: int):
    """``matrix_element`` of the opens of whole batches in numpy: as one expression it costs far more per row."""
    a, b, c = _FACTORS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_open = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            tree, place = (batch.column(i).to_numpy()[is_open] for i in (0, 2))
            base = tree % (1 << 31) * a % _WORD + seed % _WORD * b % _WORD + (place >> 32) * c + place % _WORD
            masks = np.empty((len(base), matrix.SIZE), np.int32)
            for i in range(matrix.SIZE):
                masks[:, i] = _mix((base + (i + 1) * c).astype(np.uint64)) % np.uint64(1 << matrix.SIZE)
            ends = np.concatenate([[0], np.cumsum(is_open) * matrix.SIZE]).astype(np.int32)
            offsets = pa.array(ends, mask=np.append(~is_open, False))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.ListArray.from_arrays(offsets, pa.array(masks.reshape(-1)))],
                names=["tree_id", "n", "pos", "value"],
            )

    return run


def _numbers(rows: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """One row per number in ``first..last``, made in two steps so that no row holds them all."""
    blocks = rows.select(
        "*",
        first.cast("bigint").alias("__first"),
        last.cast("bigint").alias("__last"),
        F.explode(F.sequence(F.shiftright(first, _OUTER_BITS), F.shiftright(last, _OUTER_BITS))).alias("__o"),
    ).repartition("tree_id", "__o")
    low = F.greatest(F.shiftleft("__o", _OUTER_BITS), F.col("__first"))
    high = F.least(F.shiftleft(F.col("__o") + 1, _OUTER_BITS) - 1, F.col("__last"))
    return blocks.select("*", F.explode(F.sequence(low, high)).alias(name)).drop("__first", "__last", "__o")


def _coin_range(n: int, c: int) -> np.ndarray:
    return np.arange(max(1, c << SEGMENT_BITS), min(2 * n, ((c + 1) << SEGMENT_BITS) - 1) + 1)


def _segment_sums(deepness: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [batch.column(i).to_pylist() for i in range(3)], []
            for tree, n, c in zip(*ids):
                up = _coins(tree, seed, _coin_range(n, c), deepness)
                walk = np.cumsum(np.where(up, 1, -1))
                rows.append((int(walk[-1]), int(up.sum()), int(walk.min())) if len(walk) else (0, 0, 0))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *columns], names=["tree_id", "n", "c", "net", "seg_ups", "seg_low"]
            )

    return run


def _segment_tokens(deepness: float, seed: int):
    """Tokens of the coins of a segment, given the walk before it.

    Forced opens follow the coins that reach a new minimum; the root and one open come before all coins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, n, c, base, ups, prior in zip(*(batch.column(i).to_pylist() for i in range(6))):
                k = _coin_range(n, c)
                up = _coins(tree, seed, k, deepness)
                walk = base + np.cumsum(np.where(up, 1, -1))
                low = np.minimum.accumulate(np.concatenate([[min(0, prior)], walk]))
                forced, forced_now = -low[:-1], -low[1:]
                opened = 2 + ups + np.cumsum(up) - up + forced
                kept = opened < n
                pos = 1 + k + forced
                extra = kept & (forced_now > forced)
                places = np.concatenate([pos[kept], pos[extra] + 1])
                kinds = np.concatenate([up[kept], np.ones(int(extra.sum()), bool)])
                same = [pa.array(np.full(len(places), x, np.int64)) for x in (tree, n)]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(places.astype(np.int64)), pa.array(kinds)], names=["tree_id", "n", "pos", "is_open"]
                )

    return run


def _random_tokens(specs: DataFrame, deepness: float, seed: int, matrices: bool) -> DataFrame:
    if not 0.0 <= deepness <= 1.0:
        raise ValueError("deepness must be within 0..1")
    bad = F.raise_error("n_nodes must be positive")
    n = F.when(F.col("n_nodes") <= 0, bad).otherwise(F.col("n_nodes")).cast("bigint")
    specs = materialize(specs.select(F.col("tree_id").cast("bigint").alias("tree_id"), n.alias("n")), "specs")
    seg = ["tree_id", "c"]
    ship_package(specs.sparkSession)

    # coins depend on (tree, k) only: each segment of them is one row, summed up and later walked inside its task
    segments = _numbers(specs, F.lit(0).cast("bigint"), F.shiftright(2 * F.col("n"), SEGMENT_BITS), "c")
    sums = segments.select("tree_id", "n", "c").mapInArrow(
        _segment_sums(deepness, seed), "tree_id bigint, n bigint, c bigint, net bigint, seg_ups bigint, seg_low bigint"
    )
    parts = exclusive_scan(sums, ["tree_id"], "c", {"base": ("net", "sum"), "ups_base": ("seg_ups", "sum")})
    parts = parts.withColumn("abs_low", F.col("base") + F.col("seg_low"))
    parts = exclusive_scan(parts, ["tree_id"], "c", {"prior": ("abs_low", "min")})
    parts = parts.select("tree_id", "n", "c", "base", "ups_base", F.coalesce("prior", F.lit(0)).alias("prior"))
    # opens only grow: a segment that begins with all n opened has no token to give
    parts = parts.filter(2 + F.col("ups_base") - F.least(F.lit(0), "prior") < F.col("n"))
    # rows of segments are few and small, those of their tokens are not: tasks are cut by the tokens to come
    n_segments = specs.agg(F.sum(F.shiftright(2 * F.col("n"), SEGMENT_BITS) + 1)).first()[0] or 1
    parts = parts.repartition(int(-(-n_segments // _TASK_SEGMENTS)), *seg)
    drawn = parts.mapInArrow(_segment_tokens(deepness, seed), "tree_id bigint, n bigint, pos bigint, is_open boolean")
    first = F.sequence(F.lit(0).cast("bigint"), F.when(F.col("n") > 1, 1).otherwise(0).cast("bigint"))
    head = specs.select("tree_id", "n", F.explode(first).alias("pos"), F.lit(True).alias("is_open"))
    body = materialize(head.unionAll(drawn), "generated")

    # after the last open, closes fill the positions up to 2n
    tail = body.groupBy("tree_id", "n").agg((F.max("pos") + 1).alias("at"))
    tail = _numbers(tail.filter("at < 2 * n"), F.col("at"), 2 * F.col("n") - 1, "pos")
    if matrices:
        opened = body.mapInArrow(_matrix_values(seed), "tree_id bigint, n bigint, pos bigint, value array<int>")
    else:
        value = F.when(F.col("is_open"), unit_element(F.col("tree_id"), F.lit(seed), F.col("pos")))
        opened = body.select("tree_id", "n", "pos", value.alias("value"))
    return opened.unionAll(tail.select("tree_id", "n", "pos", F.lit(None).alias("value")))


def gen_trees(specs: DataFrame, deepness: float = 0.7, seed: int = 0, matrices: bool = False) -> DataFrame:
    """Token tables of random trees for specs ``(tree_id, n_nodes)``; exactly ``2 * n_nodes`` tokens each.

    After the root, each token opens a node with probability ``deepness`` and closes one otherwise; at depth 1
    a node is always opened, so that the root closes last, and after ``n_nodes`` opens only closes follow.
    Deepness 1 gives a path and 0 a star.

    Between the forced opens the depth is a free walk of independent coins, and an open is forced each time
    the walk reaches a new minimum. So token positions are prefix sums and prefix minima over coins, which
    are scanned in segments: a single tree of any size is spread over the cluster.
    """
    return _random_tokens(specs, deepness, seed, matrices).drop("n")


def gen_chunks(
    specs: DataFrame,
    parts: int | Callable[[Column], Column],
    deepness: float = 0.7,
    seed: int = 0,
    matrices: bool = False,
) -> DataFrame:
    """Chunk tables of random trees: each tree is cut after every ``2 * n_nodes div parts + 1`` tokens.

    A chunk is one row, so let ``parts`` grow with large trees: it may be a function of the node count.
    """
    if not callable(parts) and parts <= 0:
        raise ValueError("parts must be positive")
    ways = parts(F.col("n")) if callable(parts) else F.lit(parts)
    tokens = _random_tokens(specs, deepness, seed, matrices).withColumn("ways", ways.cast("bigint"))
    algebra = path_automaton if matrices else max_path_sum
    word = token_text(F.col("value"), algebra)
    chunk = F.expr("pos div (2 * n div ways + 1)").alias("chunk_id")
    pieces = tokens.groupBy("tree_id", chunk).agg(F.array_sort(F.collect_list(F.struct("pos", word.alias("t")))).alias("ts"))
    return pieces.select("tree_id", "chunk_id", F.col("ts.t").alias("tokens"))


def gen_branching(
    spark: SparkSession, leaves: int, branches: int, frac_up: float, max_depth: int, seed: int = 0,
    matrices: bool = False,
) -> DataFrame:
    """One balanced random tree as ``(node_id, parent_id, pos_in_parent, value)``, without any shuffle.

    A list of subtrees is grouped in rounds while ``max_depth > 2`` and at least ``branches`` are left: the
    first ``frac_up`` of the list moves on unchanged, the rest is cut into runs of ``rest div branches``
    subtrees (at least one) that become the children of one new node each, in reverse run order. What is
    left becomes the children of the root. The list sizes are plain arithmetic; the nodes of a round are a
    range, and a node's parent follows from its list position by the same arithmetic.
    """
    if leaves < 0 or branches <= 0:
        raise ValueError("leaves must not be negative and branches must be positive")
    rounds: list[tuple[int, int, int, int]] = []  # kept in front, run length, new nodes, first new id
    size, next_id, depth = leaves, leaves, max_depth
    while depth > 2 and size >= branches and size > 0:
        kept = int(size * frac_up)
        run = max((size - kept) // branches, 1)
        made = -(-(size - kept) // run)
        rounds.append((kept, run, made, next_id))
        size, next_id, depth = kept + made, next_id + made, depth - 1
    root = next_id
    zero = F.lit(0).cast("bigint")
    out = spark.range(root, root + 1).select("id", F.lit(None).cast("bigint").alias("parent"), zero.alias("at"))
    for r, (first, count) in enumerate([(0, leaves), *((f, m) for _, _, m, f in rounds)]):
        # a node made in round r (leaves: 0) joins the list behind the nodes kept then
        at = F.col("id") - F.lit(first) + (rounds[r - 1][0] if r else 0)
        # the lists get shorter, so the first later round that keeps fewer takes the node: one case per round
        parent, place = F.lit(root).cast("bigint"), at
        for kept, run, made, ids in reversed(rounds[r:]):
            taken = at >= kept
            turn = F.call_function("div", at - kept, F.lit(run))
            parent = F.when(taken, ids + (made - 1) - turn).otherwise(parent)
            place = F.when(taken, F.pmod(at - kept, F.lit(run))).otherwise(place)
        nodes = spark.range(first, first + count).select(
            "id", parent.cast("bigint").alias("parent"), place.cast("bigint").alias("at")
        )
        out = out.unionAll(nodes)
    element = matrix_element if matrices else unit_element
    value = element(zero, F.lit(seed), F.col("id")).alias("value")
    return out.select(F.col("id").alias("node_id"), F.col("parent").alias("parent_id"), F.col("at").alias("pos_in_parent"), value)
