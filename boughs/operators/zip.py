"""Positional zip of two trees of the same shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = ["tree_id", "pos"]


def _paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join on the position. Keys are unique, so the shuffle is even whatever the tree sizes."""
    l = left.select(*_KEY, F.col("value").alias("l_value"), F.lit(True).alias("l_here"))
    r = right.select(*_KEY, F.col("value").alias("r_value"), F.lit(True).alias("r_here"))
    return l.join(r, _KEY, "full_outer")


def _mismatch() -> Column:
    """What is wrong at a position; NULL if both trees open or both close a node there."""
    one_ends = F.when(F.col("r_here").isNull(), "right tree ends").when(F.col("l_here").isNull(), "left tree ends")
    differ = F.col("l_value").isNull() != F.col("r_value").isNull()
    return F.coalesce(one_ends, F.when(differ, "open against close"))


def zip_trees(left: DataFrame, right: DataFrame, zipper: Callable[[Column, Column], Column]) -> DataFrame:
    """Token tables -> token table with ``zipper`` of both values at each open; raises if the shapes differ."""
    problem = _mismatch()
    where = F.concat(F.lit("trees differ: "), problem, F.lit(" at "), F.concat_ws(":", *_KEY))
    value = F.when(problem.isNotNull(), F.raise_error(where)).when(
        F.col("l_value").isNotNull(), zipper(F.col("l_value"), F.col("r_value"))
    )
    return _paired(left, right).select(*_KEY, value.alias("value"))


def sum_zip(left: DataFrame, right: DataFrame) -> DataFrame:
    return zip_trees(left, right, lambda a, b: a + b)


def zip_check(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per tree: compared positions, shape mismatches, and the first mismatch (NULL if the shapes agree)."""
    rows = _paired(left, right).select(*_KEY, _mismatch().isNotNull().alias("bad"))
    return rows.groupBy("tree_id").agg(
        F.count("*").alias("n_positions"),
        F.count_if("bad").alias("n_mismatches"),
        F.min(F.when(F.col("bad"), F.col("pos"))).alias("first_mismatch"),
    )
