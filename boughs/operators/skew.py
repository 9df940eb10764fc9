"""Left join with a fact table whose keys are unique, when one key may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: keys with more rows than this are spread; at most HOT_KEYS keys can be that large
HOT_ROWS, HOT_KEYS = 1 << 20, 1 << 16


def spread_join(
    rows: DataFrame, facts: DataFrame, key: list[str], spread_on: Column, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``rows`` LEFT JOIN ``facts`` on ``key``.

    Keys with more than ``hot_rows`` rows are found by a count with map-side combine. Only their facts are
    copied, one copy per ``hot_rows`` rows, and their rows pick a copy by a hash of ``spread_on``. The list of
    such keys is broadcast: raising the limit with the row count keeps it within HOT_KEYS rows.
    """
    counts = materialize(rows.groupBy(*key).count(), "counts")
    limit = max(hot_rows, (counts.agg(F.sum("count")).first()[0] or 0) // HOT_KEYS)
    hot = counts.filter(F.col("count") > limit)
    for k in key:
        hot = hot.filter(F.col(k).isNotNull())
    if hot.isEmpty():
        return rows.join(facts, key, "left")
    hot = hot.select(*key, F.ceil(F.col("count") / limit).cast("int").alias("__copies"))
    pick = F.pmod(F.xxhash64(spread_on), F.coalesce("__copies", F.lit(1))).cast("int")
    rows = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", pick).drop("__copies")
    copy = F.explode(F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1))
    facts = facts.join(F.broadcast(hot), key, "left").withColumn("__salt", copy).drop("__copies")
    return rows.join(facts, [*key, "__salt"], "left").drop("__salt")
