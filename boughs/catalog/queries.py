"""Registered queries: every operator over whole tables, or over trees that Spark derives from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.algebra import (
    AffineForm,
    ColumnForm,
    TreeAlgebra,
    WrapForm,
    max_path_sum,
    path_automaton,
    sum_product,
    value_sum,
)
from ..operators import edges as edge_ops
from ..operators import shape, zip as zip_ops
from ..operators.partials import chunk_partial, chunk_shape, merge_partials
from ..operators.tour import rank_edges
from ..plans import pairs as pair_ops
from ..plans.chunks import fold_chunks
from ..plans.contraction import fold_rounds
from ..plans.fold import fold_tree
from ..plans.levels import fold_forest, fold_levels, fold_ordered, fold_star
from ..plans.ordered import fold_ordered_chunks
from ..plans.pairs import fold_pairs
from ..session import materialize, new_path
from ..sources import generate, ranges, tables, text

CHUNK = 256
MERGE = 4

Query = Callable[[SparkSession, str], DataFrame]

_written: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The given tables hold no serialised trees; the derived ones are written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        _written[key] = materialize(build(), name)
    return _written[key]


def walk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the order trees with the order's key and price at each open."""

    def build() -> DataFrame:
        walk = tables.orders_walk(spark, sf_dir)
        rows = tables.walk_tokens(walk, F.struct("key", "price"))
        return rows.select("tree_id", "pos", "value.key", "value.price")

    return _once(spark, sf_dir, "walk", build)


def _tokens(spark: SparkSession, sf_dir: str, value: Callable[[], Column]) -> DataFrame:
    rows = walk_rows(spark, sf_dir)
    return rows.select("tree_id", "pos", F.when(F.col("key").isNotNull(), value()).alias("value"))


def path_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, lambda: tables.walk_value(F.col("price")))


def small_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, lambda: tables.small_value(F.col("price")))


def tag_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, lambda: tables.tag_matrix(F.col("key")))


_TOKENS = {"max_path_sum": path_tokens, "sum_product": small_tokens, "path_automaton": tag_tokens, "value_sum": path_tokens}


def _chunks(spark: SparkSession, sf_dir: str, algebra: TreeAlgebra) -> DataFrame:
    """Chunk table of the order trees, written once like a token file would be."""

    def build() -> DataFrame:
        return text.split_chunks(_TOKENS[algebra.name](spark, sf_dir), CHUNK, algebra)

    return _once(spark, sf_dir, f"chunks-{algebra.name}", build)


def _nodes(spark: SparkSession, sf_dir: str, algebra: TreeAlgebra) -> DataFrame:
    return _once(
        spark, sf_dir, f"nodes-{algebra.name}", lambda: shape.match_brackets(_TOKENS[algebra.name](spark, sf_dir))
    )


def _result(df: DataFrame, algebra: TreeAlgebra) -> DataFrame:
    if algebra is not path_automaton:
        return df.select("tree_id", "value")
    return df.select("tree_id", *[F.col("value")[i].alias(f"r{i}") for i in range(10)])


def _fold(plan: Callable, source: Callable, algebra: TreeAlgebra) -> Query:
    return lambda spark, sf_dir: _result(plan(source(spark, sf_dir, algebra), algebra), algebra)


# ---- star schema ----


_star = tables.star_nodes


def _star_fold(algebra: TreeAlgebra, value: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        levels = [rows.toDF("node_id", "parent_id", "value") for rows in tables.star_levels(spark, sf_dir)]
        levels = [rows.withColumn("value", value(F.col("value"))) for rows in levels]
        return _result(fold_star(levels, algebra), algebra)

    return run


def _star_nodes_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trees as one node table with depths."""
    return fold_levels(_star(spark, sf_dir), max_path_sum, height=4)


def _star_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of a region as a forest: the region itself is left out."""
    return fold_star(tables.star_levels(spark, sf_dir)[:-1], max_path_sum, forest=True)


def _forest_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root results given directly: the best order of each customer, combined per nation."""
    orders = tables.load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.floor("o_totalprice")).alias("v"))
    customer = tables.load(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("tree_id"), F.col("c_custkey").alias("o_custkey")
    )
    roots = customer.join(orders, "o_custkey").select("tree_id", F.col("o_custkey").alias("pos"), "v")
    return fold_forest(roots, max_path_sum)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_ops.tree_from_edges(_star(spark, sf_dir).drop("depth"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edge_ops.number_edges(_star(spark, sf_dir), height=4)
    return out.select("tree_id", "node_id", "open_pos", "close_pos")


def _ranked(source: Callable, small: int) -> Query:
    """Positions of bracket lists; the bound is small, so that the rounds for long lists run on these tables too."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges = source(spark, sf_dir).select("tree_id", "node_id", "parent_id")
        return rank_edges(edges, small).drop("parent_id")

    return run


def _conversation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_rounds(tables.conversation_nodes(spark, sf_dir), max_path_sum)


# ---- shape ----


def _flat(df: DataFrame) -> DataFrame:
    """Partials as rows: one per entry of ``cs`` and ``abs``."""
    none = F.lit(None).cast("bigint")
    cs = F.transform("cs", lambda x, i: F.struct(F.lit("cs").alias("part"), i.alias("i"), none.alias("a"), x["v"].alias("v"), x["has"].alias("has")))
    opens = F.transform("abs", lambda x, i: F.struct(F.lit("abs").alias("part"), i.alias("i"), x["a"].alias("a"), x["v"].alias("v"), x["has"].alias("has")))
    return df.select("tree_id", "chunk_id", F.inline(F.concat(cs, opens)))


def _partials(spark: SparkSession, sf_dir: str, algebra: TreeAlgebra = max_path_sum) -> DataFrame:
    return chunk_partial(_chunks(spark, sf_dir, algebra), algebra)


def _merged_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(merge_partials(_partials(spark, sf_dir), max_path_sum, MERGE - 1, MERGE))


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_ops.chunk_depth(chunk_shape(_partials(spark, sf_dir)))


def _path_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the deepest trees, in blocks small enough that chunks mate across blocks and blocks of blocks."""
    shapes = chunk_shape(chunk_partial(_path_chunks(spark, sf_dir), max_path_sum))
    return pair_ops.mating_pairs(pair_ops.chunk_depth(shapes), block_bits=3)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    partials = _once(spark, sf_dir, "partials", lambda: _partials(spark, sf_dir))
    depths = materialize(pair_ops.chunk_depth(chunk_shape(partials)), "depths")
    return pair_ops.pair_pieces(partials, depths, max_path_sum)


def _triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_ops.pair_triplets(_pieces(spark, sf_dir), max_path_sum)


def _tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tokenize(_chunks(spark, sf_dir, max_path_sum), max_path_sum)


def _text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the order trees as token text, one folder per tree, and read each folder back."""
    path = new_path(spark, "text")
    chunks = _chunks(spark, sf_dir, max_path_sum)
    text.write_tree_text(chunks, path, compression="gzip")
    parts = [
        text.read_tree_text(spark, f"{path}/tree_id={t}").withColumn("tree_id", F.lit(t).cast("bigint"))
        for t in range(tables.WALK_TREES)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return text.chunk_lines(out).select("tree_id", "chunk_id", F.col("value").alias("line"))


def _range_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order trees written without line ends, read back by byte ranges far smaller than a line."""
    path = new_path(spark, "one-line")
    text.write_tree_text(_chunks(spark, sf_dir, max_path_sum), path, line_sep=" ")
    return shape.index_tokens(ranges.read_token_ranges(spark, path, range_bytes=1 << 12, chunk_bytes=1 << 9))


def _codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result texts with ``_`` for "no value": the value of each left-open node's finished children."""
    rows = _flat(_partials(spark, sf_dir)).withColumn("t", text.format_result(F.col("v")))
    return rows.select("tree_id", "chunk_id", "part", "i", "t", text.parse_result(F.col("t")).alias("v"))


def _depth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-annotated lines of about 512 tokens each."""
    return text.serialize_depth(path_tokens(spark, sf_dir), lambda n: F.ceil(n / 512))


def _depth_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as depth-annotated text: one line, more for those above 4096 tokens."""
    nodes = tables.conversation_nodes(spark, sf_dir).withColumn("c", F.shiftright("node_id", shape.SEGMENT_BITS))
    last = nodes.groupBy("tree_id").agg((2 * F.max("node_id") + 1).alias("last"))
    # reaches the turns through their segments, so that a long conversation is not joined in one task
    per_segment = nodes.select("tree_id", "c").distinct().join(last, "tree_id")
    placed = nodes.join(per_segment, ["tree_id", "c"]).withColumn("depth", F.col("node_id"))
    tokens = shape.serialize_tree(placed.withColumn("close_pos", F.col("last") - F.col("node_id"))).drop("depth")
    return text.serialize_depth(tokens, lambda n: F.ceil(n / 4096))


def _serialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.serialize_tree(_nodes(spark, sf_dir, max_path_sum))


def _invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes of events as brackets: purchases close, other events open; counts what does not match."""
    rows = tables.load(spark, sf_dir, "events").select(
        (F.col("event_id") % 7).alias("tree_id"),
        F.expr("event_id div 7").alias("pos"),
        F.when(F.col("event_id") % 5 < 2, F.col("user_id")).alias("value"),
    )
    return shape.validate_tokens(rows)


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.tree_map(path_tokens(spark, sf_dir), lambda v: v * v + 1)


# ---- zip ----


def _zip_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_ops.sum_zip(path_tokens(spark, sf_dir), small_tokens(spark, sf_dir))


def _zip_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_ops.zip_trees(
        path_tokens(spark, sf_dir), small_tokens(spark, sf_dir), lambda a, b: F.greatest(a, b * 10)
    )


def _zip_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree t against tree t + 1: same alphabet, other shape."""
    left = path_tokens(spark, sf_dir)
    right = left.withColumn("tree_id", (F.col("tree_id") + 1) % tables.WALK_TREES)
    return zip_ops.zip_check(left, right)


# ---- generators ----


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree per nation, with a node per order of its customers."""
    customer = tables.load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # counted per customer before the join, so that a customer with many orders is one row of it
    orders = tables.load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    joined = orders.join(customer, "c_custkey")
    return joined.groupBy(F.col("c_nationkey").cast("bigint").alias("tree_id")).agg(F.sum("n").alias("n_nodes"))


def _generated(deepness: float, matrices: bool = False) -> Query:
    """Tokens of random trees, with the rows of the matrices."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tokens = generate.gen_trees(_specs(spark, sf_dir), deepness, seed=7, matrices=matrices)
        if not matrices:
            return tokens.select("tree_id", "pos", "value")
        rows = [F.get("value", F.lit(i)).alias(f"r{i}") for i in range(10)]
        return tokens.select("tree_id", "pos", F.col("value").isNotNull().alias("is_open"), *rows)

    return run


def _generated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = generate.gen_chunks(_specs(spark, sf_dir), parts=lambda n: F.ceil(n / 256), deepness=0.5, seed=7)
    return text.chunk_lines(chunks).withColumnRenamed("value", "line")


def _generated_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With unit elements the value sum of a random tree is its number of nodes."""
    return fold_chunks(generate.gen_chunks(_specs(spark, sf_dir), parts=lambda n: F.ceil(n / 512), deepness=0.6, seed=3), value_sum)


def _branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of a balanced tree with one leaf per order."""
    leaves = tables.load(spark, sf_dir, "orders").count()
    nodes = generate.gen_branching(spark, leaves, branches=8, frac_up=0.25, max_depth=5, seed=1)
    return nodes.groupBy("parent_id").agg(
        F.count("*").alias("n_children"), F.min("pos_in_parent").alias("first"), F.max("pos_in_parent").alias("last"),
        F.sum("value").alias("total"),
    )


# ---- a user-defined algebra: sum of values modulo a prime, weighted by 3 per level

_PRIME = 1_000_003

level_hash = TreeAlgebra(
    name="level_hash",
    value_type=T.LongType(),
    result_type=T.LongType(),
    hom=lambda a: a % _PRIME,
    plus=lambda a, s: (a + 3 * s) % _PRIME,
    mult=lambda x, y: (x + y) % _PRIME,
    commutative=True,
    column=ColumnForm(
        hom=lambda a: F.pmod(a, F.lit(_PRIME)),
        plus=lambda a, s: F.pmod(a + 3 * s, F.lit(_PRIME)),
        mult=lambda x, y: F.pmod(x + y, F.lit(_PRIME)),
        agg=lambda v: F.pmod(F.sum(v), F.lit(_PRIME)),
    ),
    affine=AffineForm(
        p_type=T.LongType(),
        of_node=lambda a, s: (F.pmod(a + 3 * F.coalesce(s, F.lit(0)), F.lit(_PRIME)), F.lit(3).cast("bigint")),
        compose=lambda ku, pu, kl, pl: (F.pmod(ku + pu * kl, F.lit(_PRIME)), F.pmod(pu * pl, F.lit(_PRIME))),
        apply=lambda k, p, x: F.pmod(k + p * x, F.lit(_PRIME)),
        apply_value=lambda k, p, x: (k + p * x) % _PRIME,
    ),
)


def _custom(plan: Callable, source: Callable) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(source(spark, sf_dir, max_path_sum), level_hash)

    return run


_BASE = 31


def _pair(h: Column, w: Column) -> Column:
    return F.struct(F.pmod(h, F.lit(_PRIME)).cast("bigint").alias("h"), F.pmod(w, F.lit(_PRIME)).cast("bigint").alias("w"))


def _symbol(code: Column) -> Column:
    return _pair(code, F.lit(_BASE))


def _code(code: int) -> dict[str, int]:
    return {"h": code % _PRIME, "w": _BASE}


def _joined(x: dict[str, int], y: dict[str, int]) -> dict[str, int]:
    return {"h": (x["h"] * y["w"] + y["h"]) % _PRIME, "w": x["w"] * y["w"] % _PRIME}


#: hash of a tree's bracket sequence in order: ``mult`` joins two sequences and is not commutative
order_hash = TreeAlgebra(
    name="order_hash",
    value_type=T.LongType(),
    result_type=T.StructType([T.StructField("h", T.LongType()), T.StructField("w", T.LongType())]),
    hom=lambda a: _code(2 * a + 1),
    plus=lambda a, s: _joined(_joined(_code(2 * a), s), _code(7)),
    mult=lambda x, y: _joined(x, y),
    column=ColumnForm(
        hom=lambda a: _symbol(2 * a + 1),
        plus=lambda a, s: _join(_join(_symbol(2 * a), s), _symbol(F.lit(7))),
        mult=lambda x, y: _join(x, y),
        agg=None,
    ),
    wrap=WrapForm(leaf=lambda a: _symbol(2 * a + 1), open=lambda a: _symbol(2 * a), close=lambda a: _symbol(F.lit(7))),
)


def _join(x: Column, y: Column) -> Column:
    return _pair(x["h"] * y["w"] + y["h"], x["w"] * y["w"])


def _ordered(plan: Callable, source: Callable) -> Query:
    return lambda spark, sf_dir: plan(source(spark, sf_dir), order_hash).select("tree_id", F.col("value.h").alias("value"))


def _path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return tables.orders_path(tables.orders_walk(spark, sf_dir), tables.walk_value(F.col("price")))

    return _once(spark, sf_dir, "path-nodes", build)


def _path_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _path_nodes(spark, sf_dir)
    return _once(spark, sf_dir, "path-chunks", lambda: text.split_chunks(shape.serialize_tree(nodes).drop("depth"), CHUNK))


def _forced(plan: Callable, source: Callable, algebra: TreeAlgebra, **options: int) -> Query:
    """A plan with a small bound, so that the steps for large trees run on these tables too."""
    return lambda spark, sf_dir: _result(plan(source(spark, sf_dir), algebra, **options), algebra)


def _source(source: Callable, algebra: TreeAlgebra) -> Callable:
    return lambda spark, sf_dir: source(spark, sf_dir, algebra)


def _depth_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "depth-text")
    text.write_depth_text(_depth_lines(spark, sf_dir), path, compression="gzip")
    return text.read_depth_text(spark, path, max_path_sum)


def _numbered_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "numbered")
    text.write_numbered_text(_chunks(spark, sf_dir, max_path_sum), path, compression="gzip")
    return text.chunk_lines(text.read_numbered_text(spark, path)).withColumnRenamed("value", "line")


def _select(fn: Callable[[DataFrame], DataFrame], source: Callable) -> Query:
    return lambda spark, sf_dir: fn(source(spark, sf_dir))


def _walk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, max_path_sum)


_EDGE = ["tree_id", "node_id", "parent_id"]


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for algebra in (max_path_sum, sum_product, path_automaton):
        out[f"fold_chunks_{algebra.name}"] = _fold(fold_chunks, _chunks, algebra)
        out[f"fold_levels_{algebra.name}"] = _fold(fold_levels, _nodes, algebra)
        out[f"fold_rounds_{algebra.name}"] = _fold(fold_rounds, _nodes, algebra)
        out[f"fold_pairs_{algebra.name}"] = _fold(fold_pairs, _chunks, algebra)
    out["fold_tree_max_path_sum"] = _fold(fold_tree, _chunks, max_path_sum)
    out["fold_rounds_value_sum"] = _fold(fold_rounds, _nodes, value_sum)
    out["fold_levels_star_max_path_sum"] = _star_fold(max_path_sum, lambda v: v)
    out["fold_levels_star_sum_product"] = _star_fold(sum_product, lambda v: v % 2)
    out["fold_levels_star_nodes"] = _star_nodes_fold
    out["fold_levels_star_value_sum"] = _star_fold(value_sum, lambda v: v)
    out["fold_forest_star"] = _star_forest
    out["fold_forest"] = _forest_of_customers
    out["fold_rounds_conversations"] = _conversation_fold
    out["tree_algebra_custom_chunks"] = _custom(fold_chunks, _chunks)
    out["tree_algebra_custom_levels"] = _custom(fold_levels, _nodes)
    out["tree_algebra_custom_pairs"] = _custom(fold_pairs, _chunks)

    for algebra in (max_path_sum, sum_product, path_automaton, value_sum):
        nodes, chunks = _source(_nodes, algebra), _source(_chunks, algebra)
        out[f"fold_rounds_{algebra.name}_contract"] = _forced(fold_rounds, nodes, algebra, small=64)
        out[f"fold_pairs_{algebra.name}_contract"] = _forced(fold_pairs, chunks, algebra, small=4)
    out["fold_chunks_merge_rounds"] = _forced(fold_chunks, _source(_chunks, max_path_sum), max_path_sum, fan_in=3)
    for algebra in (max_path_sum, value_sum):
        out[f"fold_rounds_path_{algebra.name}"] = _forced(fold_rounds, _path_nodes, algebra, small=64)
    out["fold_levels_path_tall"] = _forced(fold_levels, _path_nodes, max_path_sum)
    out["fold_tree_tall"] = _forced(fold_tree, _path_chunks, max_path_sum, entry_limit=256)
    out["fold_ordered_walk"] = _ordered(fold_ordered, _walk_nodes)
    out["fold_ordered_levels"] = _ordered(fold_levels, _walk_nodes)
    out["fold_ordered_path"] = _ordered(fold_ordered, _path_nodes)
    value_chunks = _source(_chunks, max_path_sum)
    out["fold_chunks_ordered"] = _ordered(fold_chunks, value_chunks)
    out["fold_ordered_chunks"] = _ordered(fold_ordered_chunks, value_chunks)
    out["fold_tree_ordered_tall"] = _ordered(lambda t, a: fold_tree(t, a, entry_limit=256), _path_chunks)
    out["match_brackets_segments"] = _select(lambda t: shape.match_brackets(t, segment_bits=5), path_tokens)
    out["token_depth_segments"] = _select(lambda t: shape.token_depth(t, segment_bits=5), path_tokens)

    out["read_depth_text"] = _depth_round_trip
    out["read_numbered_text"] = _numbered_round_trip
    out["read_tree_text"] = _text_round_trip
    out["read_token_ranges"] = _range_round_trip
    out["tokenize"] = _tokenized
    out["index_tokens"] = lambda s, d: shape.index_tokens(_chunks(s, d, max_path_sum))
    out["chunk_starts"] = lambda s, d: shape.chunk_starts(_chunks(s, d, max_path_sum))
    out["split_chunks"] = lambda s, d: text.chunk_lines(text.split_chunks(path_tokens(s, d), CHUNK)).withColumnRenamed("value", "line")
    out["serialize_depth_split"] = _depth_lines
    out["serialize_depth"] = _depth_text
    out["result_codec"] = _codec

    out["tree_map"] = _mapped
    out["leaf_filter"] = _select(lambda n: shape.leaf_filter(n).select("tree_id", "node_id", "value"), _walk_nodes)
    out["root_filter"] = _select(lambda n: shape.root_filter(n).select("tree_id", "node_id", "value"), _walk_nodes)
    out["token_depth"] = _select(shape.token_depth, path_tokens)
    out["serialize_tree"] = _serialized
    out["match_brackets"] = _select(shape.match_brackets, path_tokens)
    out["tree_edges"] = _select(shape.tree_edges, _walk_nodes)
    out["validate_tokens"] = _invalid
    out["validate_tokens_walk"] = _select(shape.validate_tokens, path_tokens)
    out["tree_root_value"] = _select(shape.tree_root_value, path_tokens)
    out["preorder"] = _select(shape.preorder, path_tokens)
    out["tree_size"] = _select(shape.tree_size, path_tokens)
    out["subtree_size"] = _select(shape.subtree_size, _walk_nodes)
    out["tree_max_depth"] = _select(shape.tree_max_depth, _walk_nodes)
    out["tree_from_edges"] = _edges
    out["number_edges"] = _numbered
    out["rank_edges_path"] = _ranked(_path_nodes, 1024)
    out["rank_edges_walk"] = _ranked(_walk_nodes, 1024)

    out["chunk_partial"] = lambda s, d: _flat(_partials(s, d))
    out["merge_partials"] = _merged_once
    out["chunk_shape"] = lambda s, d: chunk_shape(_partials(s, d))
    out["chunk_depth"] = _depths
    out["mating_pairs"] = lambda s, d: pair_ops.mating_pairs(_depths(s, d))
    out["mating_pairs_path"] = _path_pairs
    out["pair_pieces"] = _pieces
    out["pair_triplets"] = _triplets
    out["compose_pairs"] = lambda s, d: pair_ops.compose_pairs(_triplets(s, d), max_path_sum)
    out["pair_tree"] = lambda s, d: pair_ops.pair_tree(pair_ops.mating_pairs(_depths(s, d)))

    out["sum_zip"] = _zip_sum
    out["zip_trees"] = _zip_custom
    out["zip_check"] = _zip_check

    out["gen_trees"] = _generated(0.5)
    out["gen_trees_path"] = _generated(1.0)
    out["gen_trees_matrix"] = _generated(0.7, matrices=True)
    out["gen_chunks"] = _generated_chunks
    out["gen_trees_fold"] = _generated_fold
    out["gen_branching"] = _branching
    return out
