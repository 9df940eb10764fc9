"""Mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources. Documents are added up by membership pattern (the sorted set of
their sources), so the flow network has one node per pattern and one per source: the size of a pattern can be
routed to the quotas of its sources, once at cost 0, a second time at cost 1, a third time at cost 2. A cheapest
flow that fills the quotas repeats as few words as possible. Its routes are then turned into documents in
seeded order: a pattern's documents are taken some whole number of times, and the rest from the first ones.

Only pattern totals reach the driver. Patterns above ``MAX_PATTERNS`` raise an error, nothing is dropped.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .words import SPACES, same

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 7
MAX_PATTERNS = 100_000
#: documents of a pattern are ranked by hash ranges; only the range in which a quota ends is sorted
RANGES = 4096


def text_size(text: Column) -> Column:
    """Number of words: places where a word begins."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.regexp_count(plain, F.lit("[^ ]+")).cast("bigint")


def source_targets(sizes: dict, total: int, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> dict:
    """Share of the ``total`` size per source.

    Sources in code-point order, NULL last, have the weights in turn. A target stops at ``most`` times the
    source's size, and what is above is shared again by weight among the others, until none is above.
    """
    ordered = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ordered)}
    left, open_, targets = Fraction(total), list(ordered), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            targets |= {s: unit * weight[s] for s in open_}
            break
        targets |= {s: Fraction(most * sizes[s]) for s in full}
        left -= sum(targets[s] for s in full)
        open_ = [s for s in open_ if s not in targets]
    return targets


def _by_name(source: str | None) -> tuple[bool, str]:
    """Sources by code point, null last."""
    return source is None, source or ""


def route(patterns: dict[tuple, int], quotas: dict, most: int = MAX_REPEATS) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources, by successive cheapest paths.

    Costs are convex: the n-th use of a pattern's size costs n - 1 a word. A quota that cannot be filled is
    filled as far as the patterns reach. Equal costs go by the order of the patterns' names, so the flow does not
    depend on the order of ``patterns``. Each source keeps its patterns in a heap by cost, and only patterns of
    several sources are searched for detours.
    """
    names = sorted(patterns, key=lambda p: [_by_name(s) for s in p])
    rank = {p: i for i, p in enumerate(names)}
    flow = {p: dict.fromkeys(p, 0) for p in patterns}
    used = dict.fromkeys(patterns, 0)
    need = {s: int(q) for s, q in quotas.items()}
    heaps: dict = {}
    shared: dict = {}
    for p in names:
        for s in p:
            heaps.setdefault(s, []).append((0, rank[p]))
            if len(p) > 1:
                shared.setdefault(s, []).append(p)

    def step(p: tuple) -> tuple[int, int] | None:
        """Cost and room of the next word taken from a pattern."""
        size = patterns[p]
        if used[p] >= most * size:
            return None
        return used[p] // size, size - used[p] % size

    def cheapest(s: str | None) -> tuple[int, int, tuple] | None:
        """The cheapest pattern of a source; entries whose cost has risen since are put back with the new one."""
        heap = heaps.get(s, [])
        while heap:
            cost, i = heap[0]
            free = step(names[i])
            if free and free[0] == cost:
                return (*free, names[i])
            heappop(heap)
            if free:
                heappush(heap, (free[0], i))
        return None

    for s in sorted(need, key=_by_name):
        while need[s] > 0:
            # sources reachable from the quota: a pattern may move words between its sources at no cost
            came, queue, best = {s: None}, deque([s]), None
            while queue:
                at = queue.popleft()
                free = cheapest(at)
                if free and (best is None or free[0] < best[0]):
                    best = (*free, at)
                for p in shared.get(at, ()):
                    for other in p:
                        if other not in came and flow[p][other] > 0:
                            came[other] = (p, at)
                            queue.append(other)
            if best is None:
                break
            _, room, source_pattern, at = best
            amount, path, end = min(need[s], room), [], at
            while came[at] is not None:
                p, towards = came[at]
                path.append((p, at, towards))
                amount = min(amount, flow[p][at])
                at = towards
            used[source_pattern] += amount
            flow[source_pattern][end] += amount
            for p, giver, towards in path:
                flow[p][giver] -= amount
                flow[p][towards] += amount
            need[s] -= amount
    return flow


def take_seeded(docs: DataFrame, takes: DataFrame, seed: int = SEED, ranges: int = RANGES) -> DataFrame:
    """Add ``taken`` to ``docs (..., pattern, size)`` so that each pattern gives the words in ``takes``.

    Every document is taken ``words div total`` times; the remainder comes from the documents that are first
    in an order by hash of id and seed, the last of them in part. Totals of hash ranges are scanned first, so
    only the documents of one range of each pattern are sorted.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = docs.withColumn("__order", order)
    docs = docs.withColumn("__range", F.conv(F.substring("__order", 1, 3), 16, 10).cast("int") % ranges)
    sums = docs.groupBy("pattern", "__range").agg(F.sum("size").alias("in_range"))
    upto = Window.partitionBy("pattern").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_range").over(upto), F.lit(0)))
    sums = sums.withColumnRenamed("pattern", "__p").join(
        takes, same(F.col("__p"), F.col("pattern"))
    ).select("__p", F.col("__range").alias("__r"), "in_range", "before", "times", "rest")
    found = docs.join(sums, same(F.col("pattern"), F.col("__p")) & (F.col("__range") == F.col("__r")))
    inside = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_range") > F.col("rest"))
    whole = F.when(F.col("before") < F.col("rest"), F.col("size")).otherwise(F.lit(0))
    plain = found.filter(~inside).withColumn("extra", whole)
    earlier = Window.partitionBy("pattern").orderBy("__order", "doc_id", "size")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(earlier), F.lit(0))
    extra = F.least(F.greatest(F.col("rest") - start, F.lit(0)), F.col("size"))
    ending = found.filter(inside).withColumn("extra", extra)
    taken = F.col("times") * F.col("size") + F.col("extra")
    drop = ["__order", "__range", "__p", "__r", "in_range", "before", "times", "rest", "extra"]
    return plain.unionByName(ending).withColumn("taken", taken).drop(*drop)


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MAX_REPEATS,
    seed: int = SEED,
    max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """``doc_id, sources, size, source_size, target, taken`` for ``docs (doc_id, sources ARRAY, size)``.

    ``target`` and ``source_size`` are those of the document's first source. A NULL entry of ``sources`` is a
    source of its own; a document without sources takes part with no source and gives nothing. Documents
    without words are taken zero times; rows that are equal are ranked among themselves at random, which
    gives the same rows. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    pattern = F.array_sort(F.array_distinct("sources"))
    rows = materialize(docs.select("doc_id", pattern.alias("pattern"), "sources", "size"), "sizes")
    totals = rows.groupBy("pattern").agg(F.sum("size").alias("size"))
    found = totals.limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns; merge rare sources or raise max_patterns")
    patterns = {tuple(r.pattern or ()): int(r["size"] or 0) for r in found}
    sizes: dict = {}
    for p, size in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + size
    targets = source_targets(sizes, sum(size for p, size in patterns.items() if p), weights, most)
    flow = route({p: n for p, n in patterns.items() if n}, {s: round(t) for s, t in targets.items()}, most)

    takes, facts = [], []
    for p, size in patterns.items():
        words = sum(flow.get(p, {}).values())
        takes.append((list(p), words // size if size else 0, words % size if size else 0))
    for s in sizes:
        facts.append((s, sizes[s], round(float(targets[s]), 6)))
    takes = spark.createDataFrame(takes, f"pattern {rows.schema['pattern'].dataType.simpleString()}, times bigint, rest bigint")
    facts = spark.createDataFrame(facts, "__source string, source_size bigint, target double")
    empty = F.array().cast(rows.schema["pattern"].dataType)
    rows = rows.withColumn("pattern", F.coalesce("pattern", empty))
    out = take_seeded(rows, takes, seed).withColumn("__first", F.get("pattern", F.lit(0)))
    out = out.join(F.broadcast(facts), same(F.col("__first"), F.col("__source")) & (F.size("pattern") > 0), "left")
    return out.select("doc_id", "sources", "size", "source_size", "target", "taken")
