"""Trees derived from relational tables.

* ``orders_walk``: the orders of a residue class as one large tree each, by a depth walk;
* ``star_nodes``: region -> nation -> customer -> order -> line as one tree per region;
* ``conversation_nodes``: each turn is the child of the turn before, so every conversation is a path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import exclusive_scan
from ..operators.shape import SEGMENT_BITS
from ..operators.skew import spread_join

WALK_TREES = 5


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def walk_value(price: Column) -> Column:
    return F.floor(price) % 41 - 20


def small_value(price: Column) -> Column:
    """Values in -1..1, so that products of many results stay small."""
    return F.floor(price) % 3 - 1


def tag_matrix(key: Column) -> Column:
    """Row masks of the transition matrix of tag ``key % 4`` over ten states."""
    tag = key % 4
    rows = []
    for i in range(10):
        to = (F.lit(i) * (tag + 1) + tag) % 10
        stay = F.when(tag == 0, F.lit(1 << i)).otherwise(F.lit(0))
        rows.append(_bit(to).bitwiseOR(stay))
    return F.array(*rows)


def _bit(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(1 << b) for b in range(10)]), (i + 1).cast("int"))


def orders_walk(spark: SparkSession, sf_dir: str, n_trees: int = WALK_TREES) -> DataFrame:
    """Pre-order node rows ``(tree_id, i, depth, key, price)`` of ``n_trees`` trees over all orders.

    A sequence of depths with d(0) = 0 and 1 <= d(i+1) <= d(i) + 1 is the pre-order of exactly one tree. The
    depths are a reflected walk: running sum of the steps minus its running minimum, computed per key
    segment and then across segments.
    """
    seg = ["tree_id", "c"]
    k = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select(
        (k % n_trees).alias("tree_id"), F.shiftright(k, SEGMENT_BITS).alias("c"), k.alias("key"),
        F.col("o_totalprice").alias("price"),
    )
    counts = rows.groupBy(*seg).agg(F.count("*").alias("n"))
    starts = exclusive_scan(counts, ["tree_id"], "c", {"first": ("n", "sum")}).drop("n")
    here = Window.partitionBy(*seg).orderBy("key")
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    r = F.col("key") % 1009
    h = ((r * r * 7919 + r * 104729) % 1009) % 11
    step = F.when(h < 4, 1).when(h < 7, 0).when(h < 10, -1).otherwise(-2)
    local = rows.withColumn("rn", F.row_number().over(here)).join(starts, seg)
    local = local.withColumn("i", F.col("first") + F.col("rn") - 1)
    local = local.withColumn("run", F.sum(F.when(F.col("i") > 0, step).otherwise(0)).over(so_far))
    local = local.withColumn("low", F.min(F.when(F.col("i") > 0, F.col("run"))).over(so_far))
    parts = local.groupBy(*seg).agg(F.max_by("run", "key").alias("net"), F.min("low").alias("seg_low"))
    parts = exclusive_scan(parts, ["tree_id"], "c", {"base": ("net", "sum")})
    parts = parts.withColumn("abs_low", F.col("base") + F.col("seg_low"))
    parts = exclusive_scan(parts, ["tree_id"], "c", {"prior_low": ("abs_low", "min")})
    walked = local.join(parts.select(*seg, "base", "prior_low"), seg)
    lowest = F.least("prior_low", F.col("base") + F.col("low"))
    depth = F.when(F.col("i") == 0, 0).otherwise(1 + F.col("base") + F.col("run") - lowest)
    return walked.select("tree_id", "i", depth.cast("bigint").alias("depth"), "key", "price")


def orders_path(walk: DataFrame, value: Column) -> DataFrame:
    """Node table of the deepest trees: the nodes of ``orders_walk`` in a row, each the child of the one before."""
    n = walk.groupBy("tree_id").agg(F.count("*").alias("n"))
    # the size reaches the nodes through their segments, so that no tree is joined in one task
    rows = walk.withColumn("c", F.shiftright("i", SEGMENT_BITS))
    segments = rows.select("tree_id", "c").distinct().join(n, "tree_id")
    return rows.join(segments, ["tree_id", "c"]).select(
        "tree_id",
        F.col("i").alias("node_id"),
        (2 * F.col("n") - 1 - F.col("i")).alias("close_pos"),
        F.when(F.col("i") > 0, F.col("i") - 1).alias("parent_id"),
        F.col("i").cast("int").alias("depth"),
        (F.col("i") == F.col("n") - 1).alias("is_leaf"),
        value.alias("value"),
    )


def walk_tokens(walk: DataFrame, value: Column) -> DataFrame:
    """Token table of pre-order node rows ``(tree_id, i, depth, ...)``.

    Node i opens at ``2 * i - depth``. The closes between two opens follow from the two depths; the last
    node of a tree is followed by the closes of everything still open.
    """
    open_at = 2 * F.col("i") - F.col("depth")
    rows = walk.select("tree_id", "i", "depth", open_at.alias("pos"), value.alias("value"))
    rows = rows.withColumn("c", F.shiftright("i", SEGMENT_BITS))
    seg = ["tree_id", "c"]
    # the depth of the next node: inside the segment, or the first one of the next segment
    heads = rows.groupBy(*seg).agg(F.min_by("depth", "i").alias("head"))
    heads = heads.select("tree_id", (F.col("c") - 1).alias("c"), "head")
    nxt = F.coalesce(F.lead("depth").over(Window.partitionBy(*seg).orderBy("i")), F.col("head"), F.lit(0))
    rows = rows.join(heads, seg, "left").withColumn("n_closes", F.col("depth") - nxt + 1)
    closes = F.when(F.col("n_closes") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("n_closes"))).otherwise(
        F.array().cast("array<bigint>")
    )
    offsets = F.concat(F.array(F.lit(0).cast("bigint")), closes)
    return rows.select("tree_id", "pos", "value", F.explode(offsets).alias("o")).select(
        "tree_id", (F.col("pos") + F.col("o")).alias("pos"), F.when(F.col("o") == 0, F.col("value")).alias("value")
    )


#: Node keys of the star tree: level * STAR_LEVEL + key of the row
STAR_LEVEL = 10**16


def star_levels(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Lines, orders, customers, nations and regions as ``(node_id, parent_id, value)``, keyed by their own keys.

    Every line is a node. Lines have no key that is unique, and as leaves they need none: theirs is NULL.
    """
    none = F.lit(None).cast("bigint")
    return [
        load(spark, sf_dir, "lineitem").select(none, "l_orderkey", F.floor("l_quantity")),
        load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice") % 1000),
        load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint"), F.floor("c_acctbal") % 100),
        load(spark, sf_dir, "nation").select(*[F.col(c).cast("bigint") for c in ("n_nationkey", "n_regionkey", "n_nationkey")]),
        load(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint"), none, F.col("r_regionkey").cast("bigint")),
    ]


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(o, key, q)``: every line of an order with a key of its own.

    Lines are numbered inside their order by line number and, where that repeats, by all other columns. The key is
    ``order * step + number``, with a step above the largest number of lines of an order.
    """
    lines = load(spark, sf_dir, "lineitem")
    facts = lines.groupBy("l_orderkey").agg(F.count("*").alias("n")).agg(F.max("n"), F.max("l_orderkey")).first()
    step = (facts[0] or 0) + 1
    if (facts[1] or 0) * step + step >= STAR_LEVEL:
        raise ValueError("order keys times lines per order do not fit the node keys of a level")
    others = [c for c in lines.columns if c not in ("l_orderkey", "l_linenumber")]
    turn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", *others))
    return lines.select(
        F.col("l_orderkey").alias("o"), (F.col("l_orderkey") * step + turn).alias("key"), F.floor("l_quantity").alias("q")
    )


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge table ``(tree_id, node_id, parent_id, value, depth)``; a row's parent is the row it refers to."""
    _, orders, customer, nation, region = star_levels(spark, sf_dir)

    def node(level: int, key: Column) -> Column:
        return F.lit(level * STAR_LEVEL).cast("bigint") + key

    region = region.toDF("r", "none", "value")
    nation = nation.toDF("n", "r", "value")
    customer = customer.toDF("c", "n", "value").join(nation.select("n", "r"), "n")
    # a customer may hold a large part of all orders
    orders = spread_join(orders.toDF("o", "c", "value"), customer.select("c", "r"), ["c"], F.col("o"))
    orders = orders.filter(F.col("r").isNotNull())
    lines = numbered_lines(spark, sf_dir).join(orders.select("o", "r"), "o")
    none = F.lit(None).cast("bigint")
    levels = [
        region.select(F.col("r").alias("tree_id"), node(0, F.col("r")), none, "value"),
        nation.select("r", node(1, F.col("n")), node(0, F.col("r")), "value"),
        customer.select("r", node(2, F.col("c")), node(1, F.col("n")), "value"),
        orders.select("r", node(3, F.col("o")), node(2, F.col("c")), "value"),
        lines.select("r", node(4, F.col("key")), node(3, F.col("o")), "q"),
    ]
    # a literal depth per branch: a filter on it drops the other tables from the plan
    out = reduce(DataFrame.unionAll, [rows.select("*", F.lit(d)) for d, rows in enumerate(levels)])
    return out.toDF("tree_id", "node_id", "parent_id", "value", "depth")


def conversation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge table of path trees: turn t is the child of turn t - 1. The value is the length of the turn."""
    turn = F.col("turn")
    return load(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("tree_id"),
        turn.alias("node_id"),
        F.when(turn > 0, turn - 1).alias("parent_id"),
        F.length("text").cast("bigint").alias("value"),
    )
