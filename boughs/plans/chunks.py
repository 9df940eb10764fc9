"""Fold of chunked token files: partials, then an ordered merge in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import TreeAlgebra
from ..operators.partials import FAN_IN, chunk_partial, merge_partials, partial_value
from ..session import materialize


def fold_chunks(chunks: DataFrame, algebra: TreeAlgebra, fan_in: int = FAN_IN) -> DataFrame:
    """``(tree_id, chunk_id, tokens)`` -> ``(tree_id, value)``.

    Tokens never leave their task: only partials are shuffled. They are written once, which keeps the scan
    and the Python stage out of the lineage of the merge rounds and gives the number of rounds. A partial
    has at most two entries per tree level, so trees too deep for one task go to ``fold_pairs``.
    """
    partials = materialize(chunk_partial(chunks, algebra), "partials")
    return fold_partials(partials, algebra, fan_in)


def fold_partials(partials: DataFrame, algebra: TreeAlgebra, fan_in: int = FAN_IN) -> DataFrame:
    top = partials.agg(F.max("chunk_id")).first()[0] or 0
    merged = merge_partials(partials, algebra, top, fan_in)
    return merged.select("tree_id", partial_value(algebra).alias("value"))
