"""Prefix scans over an ordered key, with no group that grows with a whole tree.

A window over ``PARTITION BY tree ORDER BY chunk`` would put a tree of any size into one task.
Here the order key is cut into blocks of ``BLOCK`` consecutive keys: one window scans inside each
block, a second one scans the per-block totals, and a join adds the two. The largest group is
``max(BLOCK, keys / BLOCK)`` rows, so 10**8 chunks of a single tree need groups of about 25,000.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BLOCK_BITS = 12

_AGG = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def _combine(how: str, earlier: Column, later: Column) -> Column:
    if how == "sum":
        return F.coalesce(earlier, F.lit(0)) + F.coalesce(later, F.lit(0))
    if how == "min":
        return F.least(earlier, later)
    if how == "max":
        return F.greatest(earlier, later)
    return F.coalesce(later, earlier)


def exclusive_scan(
    df: DataFrame, keys: list[str], order: str, scans: dict[str, tuple[str, str]], block_bits: int = BLOCK_BITS
) -> DataFrame:
    """Add for each row the aggregate over all earlier rows of its key.

    ``scans`` maps an output column to ``(input column, 'sum' | 'min' | 'max' | 'last')``. ``order`` must be
    a non-negative BIGINT, unique per key. Rows with nothing before them get 0 for sums, else NULL.

    ``df`` is a summary (one row per segment or chunk) and both steps read it, so it is written first: what
    it summarises is scanned once, and its written size lets Catalyst decide how to join it back.
    """
    df = materialize(df, "summary")
    blk = "__blk"
    rows = df.withColumn(blk, F.shiftright(order, block_bits))
    inside = Window.partitionBy(*keys, blk).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)

    def total(src: str, how: str) -> Column:
        # "last" must follow the order key, which a plain aggregate does not promise
        if how == "last":
            return F.max_by(src, F.when(F.col(src).isNotNull(), F.col(order)))
        return _AGG[how](src)

    totals = rows.groupBy(*keys, blk).agg(*[total(s, h).alias(f"__t_{o}") for o, (s, h) in scans.items()])
    totals = totals.select(
        *keys, blk, *[_AGG[h](f"__t_{o}").over(across).alias(f"__p_{o}") for o, (_, h) in scans.items()]
    )
    local = rows.select("*", *[_AGG[h](s).over(inside).alias(f"__l_{o}") for o, (s, h) in scans.items()])
    joined = local.join(totals, [*keys, blk])
    out = reduce(
        lambda d, o: d.withColumn(o, _combine(scans[o][1], F.col(f"__p_{o}"), F.col(f"__l_{o}"))), scans, joined
    )
    return out.select(*df.columns, *scans)
