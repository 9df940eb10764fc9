"""Token positions of edge tables by list ranking: logarithmic rounds, at any height and for families of any width.

The brackets of a tree form a list: the open of a node is followed by the open of its first child, a close by the
open of the next sibling or by the close of the parent. An element ``(n, s)`` is the open (``s`` = 0) or the close
(``s`` = 1) of node ``n``; a leaf is one element of two tokens. ``w`` and ``d`` are the tokens and the change of depth
from an element to its successor ``(nn, ns)``.

A round flips a coin per element, and every element with heads takes over a successor with tails: they meet in one
bucket, so a round is one shuffle without a join, and a quarter of the list goes on average. Elements travel packed, one
row per pair of buckets, and are matched in numpy, a bucket of about ``BUCKET`` elements at a time. A bucket remembers
which of its elements each arrival became, and at which distance. Trees that are down to ``SMALL`` elements are ranked
in numpy, whole trees per batch; then the rounds are read backwards: ranks go the way back that the elements came.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.grouped import group_heads, whole_groups
from ..plans.contraction import check_parents
from ..session import discard, materialize, ship_package

SMALL = 1 << 17

#: elements that one task matches at a time
BUCKET = 1 << 18

#: rounds between two written tables on the way back
_BACK = 4

_RANKED = "tree_id bigint, n bigint, s int, pos bigint, depth bigint"
_LISTS = "lists array<struct<tree_id: bigint, elements: bigint, rings: bigint>>"
#: elements on the way from bucket ``sender`` to bucket ``b``, or what bucket ``b`` keeps for the way back (``sender`` is -1)
_SENT = f"b int, sender int, data binary, senders binary, sizes binary, became binary, w binary, d binary, sent binary, names binary, {_LISTS}"
_KEPT = ["senders", "sizes", "became", "w", "d", "sent", "names"]
_REPLIES = "b int, sender int, pos binary, depth binary"
_ELEMENT = [np.int64] * 5 + [np.int8]
_NAME = [np.int64, np.int64, np.int8]


def rank_edges(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """``(tree_id, node_id, parent_id, ...)`` with ``open_pos`` and ``close_pos``, and ``depth`` if it is not there yet.

    Siblings are in ``node_id`` order and the roots of a forest follow each other. Raises for a missing parent, a
    cycle, and a node number that a tree uses twice.
    """
    check_parents(edges)
    state = materialize(_elements(_ranged(edges)), "tour")
    longest, total = _longest(_sizes(state))
    ranked = _finish(state) if longest <= small else _rank_in_rounds(state, longest, total, small)
    opened, last = F.min("pos"), F.max("pos")
    close = F.when(F.count("pos") == 1, opened + 1).otherwise(last)
    placed = ranked.groupBy("tree_id", F.col("n").alias("node_id")).agg(
        opened.alias("open_pos"), close.alias("close_pos"), F.max("depth").cast("int").alias("depth")
    )
    if "depth" in edges.columns:
        placed = placed.drop("depth")
    return edges.join(placed, ["tree_id", "node_id"])


def _ranged(edges: DataFrame) -> DataFrame:
    """Nodes by family, in written ranges of about equal size, so that a wide family is spread over several."""
    top = F.col("parent_id").isNull()
    rows = edges.select(
        "tree_id", F.col("node_id").alias("n"), top.alias("top"), F.coalesce("parent_id", F.lit(0)).alias("fam")
    )
    rows = rows.repartitionByRange("tree_id", "top", "fam", "n").withColumn("part", F.spark_partition_id())
    return materialize(rows, "families")


def _elements(rows: DataFrame) -> DataFrame:
    """The bracket lists. Families are read in ranges: a window inside each range, and one row per range."""
    key = ["tree_id", "top", "fam"]
    ranges = rows.groupBy(*key, "part").agg(F.min("n").alias("first"))
    after = F.lead("first").over(Window.partitionBy(*key).orderBy("part"))
    ranges = ranges.select(*key, "part", after.alias("next_range"))
    here = F.lead("n").over(Window.partitionBy(*key, "part").orderBy("n"))
    rows_next = rows.withColumn("here", here).join(ranges, [*key, "part"])
    rows_next = rows_next.withColumn("sibling", F.coalesce("here", "next_range"))
    children = rows.filter("not top").groupBy("tree_id", F.col("fam").alias("n")).agg(F.min("n").alias("child"))
    both = rows_next.join(children, ["tree_id", "n"], "left")

    last, leaf = F.col("sibling").isNull(), F.col("child").isNull()
    up = last & ~F.col("top")
    after_n = F.coalesce("sibling", F.when(~F.col("top"), F.col("fam")))

    def element(side: Column, nn: Column, ns: Column, w: Column, d: Column) -> Column:
        return F.struct(
            side.cast("int").alias("s"), nn.alias("nn"), ns.cast("int").alias("ns"),
            w.cast("bigint").alias("w"), d.cast("bigint").alias("d"),
        )

    tail_side = F.when(after_n.isNotNull(), up.cast("int"))
    tail = element(F.when(leaf, 0).otherwise(1), after_n, tail_side, F.when(leaf, 2).otherwise(1), -up.cast("int"))
    head = element(F.lit(0), F.col("child"), F.lit(0), F.lit(1), F.lit(1))
    return both.select("tree_id", "n", F.inline(F.when(leaf, F.array(tail)).otherwise(F.array(head, tail))))


def _sizes(state: DataFrame) -> DataFrame:
    return state.groupBy("tree_id").agg(
        F.count("n").alias("elements"), F.count_if((F.col("n") == F.col("nn")) & (F.col("s") == F.col("ns"))).alias("rings")
    )


def _longest(sizes: DataFrame) -> tuple[int, int]:
    """Elements of the longest list and of all; a list that has shrunk to an element that follows itself was a cycle."""
    found = sizes.agg(F.max("elements"), F.sum("elements"), F.max("rings")).first()
    if found[2]:
        raise ValueError("the edges have a cycle")
    return found[0] or 0, found[1] or 0


@dataclass(frozen=True)
class _Sent:
    """Packed elements on their way to ``buckets`` buckets, which will send them on to ``after`` buckets."""

    table: DataFrame
    buckets: int
    after: int


def _rank_in_rounds(state: DataFrame, longest: int, total: int, small: int) -> DataFrame:
    rounds: list[_Sent] = []
    buckets = after = _buckets(total)
    sent = materialize(_pack(state, buckets), "spliced")
    discard(state)
    first = sent
    while longest > small:
        rounds.append(_Sent(sent, buckets, after))
        sent = materialize(_splice(rounds[-1], len(rounds)), "spliced")
        if len(rounds) == 1:
            discard(first)
        lists = sent.filter("sender = -1").select(F.inline("lists"))
        longest, total = _longest(lists.groupBy("tree_id").agg(F.sum("elements").alias("elements"), F.max("rings").alias("rings")))
        buckets, after = after, _buckets(total)
    replies = _replies(_finish(_unpack(sent), ["b", "sender", "i"]))
    tables = [r.table for r in rounds[1:]] + [sent]
    for i in range(len(rounds) - 1, 0, -1):
        replies = _unfold(tables[i], replies, rounds[i].buckets)
        if (len(rounds) - i) % _BACK == 0:
            replies = materialize(replies, "ranked")
    return _unfold(tables[0], replies, rounds[0].buckets, named=True)


def _buckets(elements: int) -> int:
    return max(1, -(-elements // BUCKET))


def _mixed(tree: np.ndarray, n: np.ndarray, s: np.ndarray, seed: int) -> np.ndarray:
    x = tree.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + n.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = x + (s.astype(np.uint64) + np.uint64(4 * seed + 1)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _packed(columns: list[np.ndarray]) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def _columns(data: bytes, kinds: list[type]) -> list[np.ndarray]:
    size, at, out = len(data) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(data, k, size, at))
        at += size * np.dtype(k).itemsize
    return out


def _flags(s: np.ndarray, ns: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Side of an element (and 2 if its number is NULL), side of its successor, and whether it has one."""
    return (s | ns << 2 | follows.astype(np.int64) << 3).astype(np.int8)


def _meeting(element: list[np.ndarray], number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each element takes over its successor in this round, and the element at which it is matched."""
    tree, n, nn, _, _, flags = element
    s, ns = flags & 3, flags >> 2 & 1
    heads, next_heads = (_mixed(tree, *e, 2 * number) >> np.uint64(63) == 1 for e in ((n, s), (nn, ns)))
    takes = (flags & 8 > 0) & heads & ~next_heads
    return takes, np.where(takes, nn, n), np.where(takes, ns, s)


def _deal(element: list[np.ndarray], number: int, buckets: int) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """Elements by the bucket where they are matched: their order, and a packed piece per bucket."""
    _, n, s = _meeting(element, number)
    to = (_mixed(element[0], n, s, 2 * number + 1) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    cuts = np.append(group_starts(to[order]), len(order))
    rows = [c[order] for c in element]
    return order, [(int(to[order[a]]), _packed([c[a:b] for c in rows])) for a, b in zip(cuts, cuts[1:])]


def group_starts(*keys: np.ndarray) -> np.ndarray:
    change = np.ones(len(keys[0]), bool)
    change[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(change)


def _match(element: list[np.ndarray], number: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Elements that stay of a whole bucket; for each that came, which of them it became, and its distance from it."""
    tree, _, _, w, d, flags = element
    takes, kn, ks = _meeting(element, number)
    order = np.lexsort((2 * ks + takes, kn, tree))
    starts = group_starts(tree[order], kn[order], ks[order])
    sizes = np.diff(starts, append=len(order))
    gone = order[starts]
    joined = np.flatnonzero(sizes == 2)
    taker = order[starts[joined] + 1]
    if (sizes > 2).any() or takes[gone].any() or not takes[taker].all():
        raise ValueError("a node number is used twice")
    stay = [c[gone] for c in element]
    stay[1][joined] = element[1][taker]
    stay[3][joined] += w[taker]
    stay[4][joined] += d[taker]
    stay[5][joined] = stay[5][joined] & ~3 | flags[taker] & 3
    became = np.empty(len(order), np.int32)
    became[order] = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
    by_w, by_d = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    by_w[gone[joined]], by_d[gone[joined]] = w[taker], d[taker]
    return stay, [became, by_w, by_d]


def _list_sizes(element: list[np.ndarray]) -> list[dict[str, int]]:
    tree, n, nn, _, _, flags = element
    ring = (flags & 8 > 0) & (n == nn) & (flags & 3 == flags >> 2 & 1)
    ids, code = np.unique(tree, return_inverse=True)
    count, rings = np.bincount(code), np.bincount(code, weights=ring)
    return [{"tree_id": t, "elements": c, "rings": int(r)} for t, c, r in zip(ids.tolist(), count.tolist(), rings.tolist())]


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _pack(state: DataFrame, buckets: int) -> DataFrame:
    """The elements on their way to the first round. Lists of trees without a number are in no result."""

    def send(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        col = {c: table.column(c).to_numpy() for c in table.column_names}
        element = [*(col[c] for c in ("tree_id", "n", "nn", "w", "d")), _flags(col["s"], col["ns"], col["follows"])]
        return _rows([{"b": b, "sender": 0, "data": x} for b, x in _deal(element, 1, buckets)[1]], arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BUCKET:
                yield send(held)
                held, size = [], 0
        if size:
            yield send(held)

    ship_package(state.sparkSession)
    arrow = to_arrow_schema(T.StructType.fromDDL(_SENT))
    zero = F.lit(0).cast("bigint")
    rows = state.filter("tree_id is not null").select(
        F.col("tree_id").cast("bigint").alias("tree_id"),
        *[F.coalesce(F.col(c).cast("bigint"), zero).alias(c) for c in ("n", "nn", "w", "d", "ns")],
        (F.col("s") + F.when(F.col("n").isNull(), 2).otherwise(0)).cast("bigint").alias("s"),
        F.col("nn").isNotNull().alias("follows"),
    )
    return rows.mapInArrow(run, _SENT)


def _by_bucket(table: pa.Table) -> Iterator[pa.Table]:
    heads = group_heads(table, ["b"])
    for at, to in zip(heads, np.append(heads[1:], table.num_rows)):
        yield table.slice(at, to - at)


def _splice(sent: _Sent, number: int) -> DataFrame:
    """One round: what stays in each bucket is sent on to the next round, and what came is kept for the way back."""
    after = sent.after

    def splice(rows: pa.Table) -> pa.RecordBatch:
        b, pieces = rows.column("b")[0].as_py(), [_columns(x, _ELEMENT) for x in rows.column("data").to_pylist()]
        element = [np.concatenate(c) for c in zip(*pieces)]
        stay, kept = _match(element, number)
        order, dealt = _deal(stay, number + 1, after)
        names = [element[0], element[1], element[5] & 3] if number == 1 else []
        row = {"b": b, "sender": -1, "sent": order.astype(np.int32).tobytes(), "names": _packed(names), "lists": _list_sizes(stay)}
        row |= {c: x.tobytes() for c, x in zip(("became", "w", "d"), kept)}
        row["senders"] = rows.column("sender").to_numpy().astype(np.int32).tobytes()
        row["sizes"] = np.array([len(p[0]) for p in pieces], np.int64).tobytes()
        return _rows([row, *({"b": to, "sender": b, "data": x} for to, x in dealt)], arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["b"]):
            yield from map(splice, _by_bucket(table))

    arrow = to_arrow_schema(T.StructType.fromDDL(_SENT))
    rows = sent.table.filter("sender >= 0").select("b", "sender", "data")
    return rows.repartitionById(sent.buckets, F.col("b")).sortWithinPartitions("b", "sender").mapInArrow(run, _SENT)


def _unpack(sent: DataFrame) -> DataFrame:
    """The elements as rows, with the bucket that sent them (``b``), the one they were sent to, and their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for to, b, data in zip(*(batch.column(c).to_pylist() for c in ("b", "sender", "data"))):
                tree, n, nn, w, d, flags = _columns(data, _ELEMENT)
                same = np.ones(len(n), np.int64)
                follows = flags & 8 > 0
                columns = [pa.array(tree), pa.array(n), pa.array((flags & 3).astype(np.int32)), pa.array(nn, mask=~follows)]
                columns += [pa.array((flags >> 2 & 1).astype(np.int32), mask=~follows), pa.array(w), pa.array(d)]
                columns += [pa.array(same * b), pa.array(same * to), pa.array(np.arange(len(n)))]
                yield pa.RecordBatch.from_arrays(columns, ["tree_id", "n", "s", "nn", "ns", "w", "d", "b", "sender", "i"])

    schema = "tree_id bigint, n bigint, s int, nn bigint, ns int, w bigint, d bigint, b bigint, sender bigint, i bigint"
    return sent.filter("sender >= 0").select("b", "sender", "data").mapInArrow(run, schema)


def _replies(ranked: DataFrame) -> DataFrame:
    """Ranks in the order in which the elements were sent, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["b", "sender"]):
            heads = group_heads(table, ["b", "sender"])
            b, sender, pos, depth = (table.column(c).to_numpy() for c in ("b", "sender", "pos", "depth"))
            cuts = zip(heads, np.append(heads[1:], table.num_rows))
            yield _rows([{"b": b[x], "sender": sender[x], "pos": pos[x:y].tobytes(), "depth": depth[x:y].tobytes()} for x, y in cuts], arrow)

    arrow = to_arrow_schema(T.StructType.fromDDL(_REPLIES))
    rows = ranked.repartition("b", "sender").sortWithinPartitions("b", "sender", "i")
    return rows.mapInArrow(run, _REPLIES)


def _unfold(spliced: DataFrame, replies: DataFrame, buckets: int, named: bool = False) -> DataFrame:
    """Ranks of the elements that came to a round from those of the elements that it sent on."""

    def unfold(rows: pa.Table) -> pa.RecordBatch:
        kept = {c: rows.column(c)[0].as_py() for c in _KEPT}
        pos, depth = (np.frombuffer(b"".join(rows.column(c).to_pylist()[1:]), np.int64) for c in ("pos", "depth"))
        order = np.frombuffer(kept["sent"], np.int32)
        became = np.frombuffer(kept["became"], np.int32)
        ranks = []
        for sent, by in ((pos, kept["w"]), (depth, kept["d"])):
            at = np.empty(len(order), np.int64)
            at[order] = sent
            ranks.append(at[became] + np.frombuffer(by, np.int64))
        if named:
            tree, n, s = _columns(kept["names"], _NAME)
            columns = [pa.array(tree), pa.array(n), pa.array(s.astype(np.int32)), *map(pa.array, ranks)]
            return pa.RecordBatch.from_arrays(columns, ["tree_id", "n", "s", "pos", "depth"]).filter(pa.array(s < 2))
        b, cuts = rows.column("b")[0].as_py(), np.append(0, np.cumsum(np.frombuffer(kept["sizes"], np.int64)))
        back = zip(np.frombuffer(kept["senders"], np.int32).tolist(), cuts, cuts[1:])
        return _rows([{"b": to, "sender": b, "pos": ranks[0][x:y].tobytes(), "depth": ranks[1][x:y].tobytes()} for to, x, y in back], arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["b"]):
            yield from map(unfold, _by_bucket(table))

    arrow = to_arrow_schema(T.StructType.fromDDL(_REPLIES))
    kept = spliced.filter("sender = -1").select("b", "sender", *_KEPT)
    rows = kept.unionByName(replies, allowMissingColumns=True).repartitionById(buckets, F.col("b"))
    return rows.sortWithinPartitions("b", "sender").mapInArrow(run, _RANKED if named else _REPLIES)


def rank_lists(tree: np.ndarray, key: np.ndarray, after: np.ndarray, w: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and depth of each element by pointer jumping; ``after`` is a key or -1, and rows are sorted by tree."""
    order = np.argsort(key, kind="stable")
    ends, size = after < 0, len(key)
    if (key[order[1:]] == key[order[:-1]]).any():
        raise ValueError("a node number is used twice")
    place = order[np.minimum(np.searchsorted(key, after, sorter=order), size - 1)]
    if (~ends & (key[place] != after)).any():
        raise ValueError("parent not found")
    jump = np.append(np.where(ends, size, place), size)
    to_end, sink = np.append(w, 0), np.append(d, 0)
    for _ in range(size.bit_length() + 1):
        if (jump == size).all():
            break
        to_end, sink, jump = to_end + to_end[jump], sink + sink[jump], jump[jump]
    else:
        raise ValueError("the edges have a cycle")
    heads = np.flatnonzero(np.diff(tree, prepend=tree[0] - 1))
    total = np.repeat(np.maximum.reduceat(to_end[:-1], heads), np.diff(heads, append=size))
    return total - to_end[:-1], -sink[:-1]


def _finish(state: DataFrame, others: list[str] | None = None) -> DataFrame:
    """Rank lists of at most ``SMALL`` elements, whole trees per batch; BIGINT columns ``others`` stay."""
    others = others or []

    def rank(table: pa.Table) -> pa.RecordBatch:
        tree, n, s, w, d = (table.column(c).to_numpy() for c in ("tree_id", "n", "s", "w", "d"))
        nn, ns = (table.column(c).fill_null(0).to_numpy() for c in ("nn", "ns"))
        ids, code = np.unique(n, return_inverse=True)
        group = np.cumsum(np.diff(tree, prepend=tree[0]) != 0) * (2 * len(ids))
        there = np.minimum(np.searchsorted(ids, nn), len(ids) - 1)
        known = table.column("nn").is_valid().to_numpy()
        if (known & (ids[there] != nn)).any():
            raise ValueError("parent not found")
        after = np.where(known, group + 2 * there + ns, -1)
        pos, depth = rank_lists(tree, group + 2 * code + s, after, w, d)
        columns = [table.column(c).combine_chunks() for c in ("tree_id", "n", "s", *others)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(pos), pa.array(depth)], ["tree_id", "n", "s", *others, "pos", "depth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["tree_id"]):
            yield rank(table)

    ship_package(state.sparkSession)
    rows = state.withColumns({c: F.col(c).cast("bigint") for c in ("tree_id", "n", "nn")})
    schema = "tree_id bigint, n bigint, s int, " + "".join(f"{c} bigint, " for c in others) + "pos bigint, depth bigint"
    return rows.repartition("tree_id").sortWithinPartitions("tree_id").mapInArrow(run, schema)
