"""Shape operators on token tables ``(tree_id, pos, value)``; a NULL value is a close.

Every operator works in segments of ``2**SEGMENT_BITS`` positions. Windows run inside a segment, and only
per-segment summaries and the few brackets that a segment leaves unmatched go into the second step. All
in-segment windows share one hash partitioning on ``(tree_id, c)``, so the tokens are shuffled once. Bracket matching
packs each segment into one row in the same pass (``brackets.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .brackets import pack_segments
from .match import CLOSE, QUERY, match_levels
from .scan import exclusive_scan

SEGMENT_BITS = 14

#: chunk starts that are broadcast: three numbers each, about 64 MB in all
HELD_STARTS = 1 << 20

_SEG = ["tree_id", "c"]


def _is_open() -> Column:
    return F.col("value").isNotNull()


def chunk_starts(chunks: DataFrame) -> DataFrame:
    """Token count of each chunk and the position of its first token."""
    sizes = chunks.select("tree_id", "chunk_id", F.size("tokens").cast("bigint").alias("n_tokens"))
    return exclusive_scan(sizes, ["tree_id"], "chunk_id", {"start": ("n_tokens", "sum")})


def index_tokens(chunks: DataFrame) -> DataFrame:
    """Chunks ``(tree_id, chunk_id, tokens)`` -> ``(tree_id, pos, token)`` with the global token position.

    Up to ``HELD_STARTS`` chunks the starts are broadcast and the tokens stay where they are read; beyond that they
    are joined by a shuffle.
    """
    starts = materialize(chunk_starts(chunks).drop("n_tokens"), "starts")
    located = chunks.join(F.broadcast(starts) if starts.count() <= HELD_STARTS else starts, ["tree_id", "chunk_id"])
    return located.select("tree_id", "start", F.posexplode("tokens").alias("i", "token")).select(
        "tree_id", (F.col("start") + F.col("i")).alias("pos"), "token"
    )


def token_depth(tokens: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """Add ``depth``: the depth of the node that a token opens or closes, 0 for roots."""
    return _leveled(tokens, segment_bits).select(*tokens.columns, F.col("level").cast("int").alias("depth"))


def _leveled(tokens: DataFrame, segment_bits: int) -> DataFrame:
    step = F.when(_is_open(), 1).otherwise(-1)
    rows = tokens.withColumn("c", F.shiftright("pos", segment_bits))
    net = rows.groupBy(*_SEG).agg(F.sum(step).alias("net"))
    starts = exclusive_scan(net, ["tree_id"], "c", {"start": ("net", "sum")}).drop("net")
    here = Window.partitionBy(*_SEG).orderBy("pos")
    local = rows.withColumn("run", F.sum(step).over(here.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "behind_open", F.coalesce(F.lag(_is_open()).over(here), F.lit(False))
    )
    level = F.col("start") + F.col("run") - F.when(_is_open(), 1).otherwise(0)
    return local.join(starts, _SEG).withColumn("level", level)


def match_brackets(tokens: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """Node table of a token table, for any node size and depth.

    ``(tree_id, node_id, close_pos, parent_id, depth, is_leaf, value)``; ``node_id`` is the open position, so
    siblings are in ``node_id`` order. An unclosed node has a NULL ``close_pos``.
    """
    packed = materialize(pack_segments(tokens, segment_bits), "segments")
    starts = exclusive_scan(packed.select(*_SEG, "net"), ["tree_id"], "c", {"start": ("net", "sum")}).drop("net")
    # one row per segment: its unmatched brackets and its lowest depth
    query = F.struct(
        (F.col("low") - 1).alias("level"), F.lit(QUERY).alias("kind"), F.lit(None).cast("bigint").alias("pos")
    )
    ends = packed.select(*_SEG, "low", "loose").join(starts, _SEG)
    loose_rows = ends.select(*_SEG, "start", F.explode(F.concat("loose", F.array(query))).alias("e"))
    loose_rows = loose_rows.select(*_SEG, "start", (F.col("start") + F.col("e.level")).alias("level"), "e.kind", "e.pos")
    found = match_levels(loose_rows)

    # back to the segments: the open above each level that the segment climbs down to, and the close of
    # each node that it leaves open; both are dense in the level, so an array index finds them
    inward = F.struct("c", F.lit(0).alias("side"), F.col("ref.pos").alias("pos"), "start")
    outward = F.struct(F.col("ref.c").alias("c"), F.lit(1).alias("side"), "pos", F.lit(None).cast("bigint").alias("start"))
    both = F.when((F.col("kind") == CLOSE) & F.col("ref").isNotNull(), F.array(inward, outward))
    both = both.otherwise(F.array(inward))

    def dense(side: int) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("level", "pos"))))

    links = (
        found.select("tree_id", "level", F.inline(both))
        .groupBy(*_SEG)
        .agg(dense(0).alias("ups"), dense(1).alias("downs"), F.max("start").alias("start"))
    )

    def at(name: str, level: Column) -> Column:
        entries = F.col(name)
        return F.get(entries, (level - F.get(entries, F.lit(0))["level"]).cast("int"))["pos"]

    # the facts of a segment meet its packed row, not its tokens; its query gives every segment a row of facts
    nodes = packed.select(*_SEG, "nodes").join(links, _SEG)
    nodes = nodes.select("tree_id", "start", "ups", "downs", F.inline("nodes"))
    nodes = nodes.withColumn("level", F.col("start") + F.col("level"))
    close = F.coalesce("close_here", at("downs", F.col("level")))
    return nodes.select(
        "tree_id",
        F.col("pos").alias("node_id"),
        close.alias("close_pos"),
        F.coalesce("parent_here", at("ups", F.col("level") - 1)).alias("parent_id"),
        F.col("level").cast("int").alias("depth"),
        (close == F.col("pos") + 1).alias("is_leaf"),
        "value",
    )


def validate_tokens(tokens: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """One row per tree: extra closes, unclosed opens, and whether the stream is a well-formed forest."""
    step = F.when(_is_open(), 1).otherwise(-1)
    here = Window.partitionBy(*_SEG).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("c", F.shiftright("pos", segment_bits)).withColumn("run", F.sum(step).over(here))
    parts = rows.groupBy(*_SEG).agg(F.sum(step).alias("net"), F.min("run").alias("low"))
    parts = exclusive_scan(parts, ["tree_id"], "c", {"start": ("net", "sum")})
    out = parts.groupBy("tree_id").agg(
        F.min(F.col("start") + F.col("low")).alias("low"), F.sum("net").alias("net")
    )
    extra = F.greatest(-F.col("low"), F.lit(0)).cast("bigint")
    return out.select(
        "tree_id",
        extra.alias("extra_closes"),
        (F.col("net") + extra).alias("unclosed_opens"),
        ((F.col("low") >= 0) & (F.col("net") == 0)).alias("valid"),
    )


def tree_edges(nodes: DataFrame) -> DataFrame:
    """Parent-child pairs of a node table."""
    return nodes.filter(F.col("parent_id").isNotNull()).select("tree_id", "parent_id", "node_id")


def leaf_filter(nodes: DataFrame) -> DataFrame:
    return nodes.filter("is_leaf")


def root_filter(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("parent_id").isNull())


def tree_map(nodes: DataFrame, fn) -> DataFrame:
    """Map node values (or token values: closes stay closes); the shape is kept."""
    return nodes.withColumn("value", F.when(F.col("value").isNotNull(), fn(F.col("value"))))


def tree_root_value(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("tree_id").agg(F.min_by("value", "pos").alias("value"))


def preorder(tokens: DataFrame) -> DataFrame:
    """Node values in pre-order: ``rank`` counts the opens of a tree from 0, globally sorted."""
    rows = tokens.withColumn("c", F.shiftright("pos", SEGMENT_BITS))
    counts = rows.groupBy(*_SEG).agg(F.count("value").alias("n"))
    starts = exclusive_scan(counts, ["tree_id"], "c", {"first": ("n", "sum")}).drop("n")
    local = rows.filter(_is_open()).withColumn(
        "i", F.row_number().over(Window.partitionBy(*_SEG).orderBy("pos")) - 1
    )
    ranked = local.join(starts, _SEG).select("tree_id", (F.col("first") + F.col("i")).alias("rank"), "pos", "value")
    return ranked.orderBy("tree_id", "rank")


def tree_size(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("tree_id").agg(F.count("value").alias("n_nodes"))


def subtree_size(nodes: DataFrame) -> DataFrame:
    """Size of the subtree of each node, from the bracket positions alone."""
    size = F.expr("(close_pos - node_id + 1) div 2")
    return nodes.select("tree_id", "node_id", size.alias("size"))


def tree_max_depth(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tree_id").agg(F.max("depth").alias("max_depth"))


def serialize_tree(nodes: DataFrame) -> DataFrame:
    """Node table -> depth-annotated tokens ``(tree_id, pos, depth, value)``."""
    ends = F.array(
        F.struct(F.col("node_id").alias("pos"), F.col("value").alias("value")),
        F.struct(F.col("close_pos").alias("pos"), F.lit(None).alias("value")),
    )
    return nodes.select("tree_id", "depth", F.explode(ends).alias("e")).select("tree_id", "e.pos", "depth", "e.value")
