"""Token text: readers and writers for trees stored as lines of ``value`` and ``/`` tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.algebra import TreeAlgebra
from ..operators.scan import exclusive_scan
from ..operators.shape import SEGMENT_BITS, index_tokens, token_depth, validate_tokens
from ..operators.skew import spread_join
from ..session import materialize

CLOSE_TOKEN = "/"


def read_tree_text(spark: SparkSession, path: str | list[str], per_file: bool = False, **options) -> DataFrame:
    """Text lines -> chunk table ``(tree_id, chunk_id, tokens)``. Blank lines are skipped.

    The lines of all files in path order are one tree (``tree_id`` 0), or one tree per file. Line order is
    not partition order: a split is known by its file and offset, lines are counted inside their split, and
    a scan over the per-split counts gives dense chunk numbers. The lines are written as a table first:
    splits depend on the cluster size of the moment, so the text must be read only once.
    """
    lines = spark.read.options(**options).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")
    )
    lines = lines.filter(F.length(F.trim("value")) > 0).withColumn("row", F.monotonically_increasing_id())
    lines = materialize(lines.withColumn("tokens", split_line(F.col("value"))).drop("value"), "lines")
    splits = lines.groupBy("file", "at").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    files = _in_path_order(splits.groupBy("file").agg(F.sum("n").alias("n_file")))
    starts = exclusive_scan(splits, ["file"], "at", {"start": ("n", "sum")}, block_bits=40).join(files, "file")
    tree, offset = (F.col("file_no"), F.lit(0)) if per_file else (F.lit(0), F.col("lines_before"))
    starts = starts.select(
        "file", "at", tree.cast("bigint").alias("tree_id"), (offset + F.col("start") - F.col("first")).alias("shift")
    )
    return lines.join(starts, ["file", "at"]).select(
        "tree_id", (F.col("row") + F.col("shift")).alias("chunk_id"), "tokens"
    )


def _in_path_order(files: DataFrame) -> DataFrame:
    """``(file, n_file)`` -> ``(file, file_no, lines_before)``, numbered by path in ranges of files."""
    files = files.repartitionByRange("file").withColumn("part", F.spark_partition_id().cast("bigint"))
    files = materialize(files.withColumn("all", F.lit(0)), "files")
    parts = files.groupBy("all", "part").agg(F.count("*").alias("n"), F.sum("n_file").alias("n_lines"))
    scans = {"files_base": ("n", "sum"), "lines_base": ("n_lines", "sum")}
    parts = exclusive_scan(parts, ["all"], "part", scans).drop("n", "n_lines")
    here = Window.partitionBy("all", "part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    rows = files.select(
        "*", F.count("file").over(here).alias("i"), F.coalesce(F.sum("n_file").over(here), F.lit(0)).alias("lines_here")
    )
    return rows.join(parts, ["all", "part"]).select(
        "file", (F.col("files_base") + F.col("i")).alias("file_no"), (F.col("lines_base") + F.col("lines_here")).alias("lines_before")
    )


def split_line(line: Column) -> Column:
    return F.split(F.trim(line), " +")


def tokenize(chunks: DataFrame, algebra: TreeAlgebra) -> DataFrame:
    """Chunk table -> token table ``(tree_id, pos, value)``; a close token becomes NULL."""
    text = F.nullif(F.col("token"), F.lit(CLOSE_TOKEN))
    return index_tokens(chunks).select("tree_id", "pos", algebra.parse_col(text).alias("value"))


def token_text(value: Column, algebra: TreeAlgebra | None = None) -> Column:
    text = algebra.format_col(value) if algebra else value.cast("string")
    return F.coalesce(text, F.lit(CLOSE_TOKEN))


def parse_result(text: Column) -> Column:
    """Text form of a nullable whole number, ``_`` for "no value"."""
    return F.nullif(text, F.lit("_")).cast("bigint")


def format_result(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("_"))


def split_chunks(tokens: DataFrame, size: int, algebra: TreeAlgebra | None = None) -> DataFrame:
    """Cut a token table into chunks of ``size`` tokens. Groups hold ``size`` rows, whatever the tree size."""
    pieces = tokens.groupBy("tree_id", F.expr(f"pos div {int(size)}").alias("chunk_id")).agg(
        F.array_sort(F.collect_list(F.struct("pos", token_text(F.col("value"), algebra).alias("t")))).alias("ts")
    )
    return pieces.select("tree_id", "chunk_id", F.col("ts.t").alias("tokens"))


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """Chunk table -> text lines ``(tree_id, chunk_id, value)``."""
    return chunks.select("tree_id", "chunk_id", F.concat_ws(" ", "tokens").alias("value"))


def serialize_depth(tokens: DataFrame, parts: int | Callable[[Column], Column]) -> DataFrame:
    """Depth-annotated text, cut ``parts`` ways: lines ``id<TAB>depth token depth token ...``.

    A tree of n tokens is cut every ``max(n div parts, 1)`` tokens, so a remainder makes one more line.
    With ``parts=1`` a tree is one line. A line is one row, so let ``parts`` grow with the tree where trees
    have no size bound: it may be a function of the token count.
    """
    ways = parts if callable(parts) else lambda n: F.lit(parts)
    # the per-tree cut reaches the tokens through their segments: no join on the tree alone
    rows = token_depth(tokens).withColumn("c", F.shiftright("pos", SEGMENT_BITS))
    segments = tokens.groupBy("tree_id", F.shiftright("pos", SEGMENT_BITS).alias("c")).agg(F.count("*").alias("n"))
    cuts = segments.groupBy("tree_id").agg(F.sum("n").alias("n"))
    cuts = cuts.select("tree_id", F.greatest(F.floor(F.col("n") / ways(F.col("n"))), F.lit(1)).alias("m"))
    segments = spread_join(segments, cuts, ["tree_id"], F.col("c")).select("tree_id", "c", "m")
    rows = rows.join(segments, ["tree_id", "c"])
    word = F.concat_ws(" ", F.col("depth").cast("string"), token_text(F.col("value")))
    lines = rows.groupBy("tree_id", F.expr("pos div m").alias("line")).agg(
        F.array_sort(F.collect_list(F.struct("pos", word.alias("w")))).alias("ws")
    )
    return lines.select(
        "tree_id", "line", F.concat(F.col("line").cast("string"), F.lit("\t"), F.concat_ws(" ", "ws.w")).alias("text")
    )


def write_tree_text(chunks: DataFrame, path: str, compression: str = "none", line_sep: str = "\n") -> None:
    """Write a chunk table as token text, one folder per tree, lines in chunk order across part files.

    With a blank as ``line_sep`` a part file is one line; ``read_token_ranges`` reads such files.

    Range partitioning keeps neighbouring chunks together, and part files sort by name, so that
    ``read_tree_text`` on a tree's folder restores the order.
    """
    lines = chunk_lines(chunks).repartitionByRange("tree_id", "chunk_id").sortWithinPartitions("tree_id", "chunk_id")
    writer = lines.select("tree_id", "value").write.option("compression", compression).option("lineSep", line_sep)
    writer.partitionBy("tree_id").text(path)


def write_numbered_text(chunks: DataFrame, path: str, compression: str = "none") -> None:
    """Write chunk tables of any number of trees as lines ``tree<TAB>chunk<TAB>tokens``, sorted over all files.

    The numbers are in the lines, so neither folders nor file order carry meaning.
    """
    lines = chunk_lines(chunks).repartitionByRange("tree_id", "chunk_id").sortWithinPartitions("tree_id", "chunk_id")
    text = F.concat_ws("\t", F.col("tree_id").cast("string"), F.col("chunk_id").cast("string"), "value")
    lines.select(text.alias("value")).write.option("compression", compression).text(path)


def read_numbered_text(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Lines of ``write_numbered_text`` -> chunk table; map-only."""
    fields = F.split("value", "\t", 3)
    rows = spark.read.options(**options).text(path).filter(F.length(F.trim("value")) > 0)
    return rows.select(
        fields[0].cast("bigint").alias("tree_id"), fields[1].cast("bigint").alias("chunk_id"), split_line(fields[2]).alias("tokens")
    )


def write_depth_text(lines: DataFrame, path: str, compression: str = "none") -> None:
    """Write lines of ``serialize_depth`` as ``tree<TAB>line<TAB>depth token depth token ...``."""
    rows = lines.repartitionByRange("tree_id", "line").sortWithinPartitions("tree_id", "line")
    text = F.concat_ws("\t", F.col("tree_id").cast("string"), "text")
    rows.select(text.alias("value")).write.option("compression", compression).text(path)


def read_depth_text(spark: SparkSession, path: str | list[str], algebra: TreeAlgebra, **options) -> DataFrame:
    """Depth-annotated text -> tokens ``(tree_id, pos, value, depth)``, checked.

    Lines are ``tree<TAB>line<TAB>...``, or ``line<TAB>...`` for a single tree, which gets the number 0. Raises for a
    token without a depth, a depth that does not follow from the tokens before it, an extra close and an
    unclosed open.
    """
    rows = spark.read.options(**options).text(path).filter(F.length(F.trim("value")) > 0)
    fields = F.split("value", "\t", 3)
    many = F.size(fields) > 2
    return parse_depth_lines(
        rows.select(
            F.when(many, fields[0]).otherwise(F.lit("0")).cast("bigint").alias("tree_id"),
            F.when(many, F.substring_index("value", "\t", -2)).otherwise(F.col("value")).alias("text"),
        ),
        algebra,
    )


def parse_depth_lines(lines: DataFrame, algebra: TreeAlgebra) -> DataFrame:
    """Lines ``(tree_id, text)`` as ``serialize_depth`` makes them -> checked tokens; see ``read_depth_text``."""
    fields = F.split("text", "\t", 2)
    words = split_line(fields[1])
    odd = F.raise_error("depth-annotated text: a token has no depth")
    pairs = F.transform(
        F.sequence(F.lit(0), F.when(F.size("w") % 2 == 1, odd.cast("int")).otherwise(F.shiftright(F.size("w"), 1) - 1)),
        lambda i: F.concat_ws(" ", F.get("w", (2 * i).cast("int")), F.get("w", (2 * i + 1).cast("int"))),
    )
    chunks = lines.select("tree_id", fields[0].cast("bigint").alias("chunk_id"), words.alias("w"))
    chunks = materialize(chunks.select("tree_id", "chunk_id", pairs.alias("tokens")), "depth-lines")
    pair = F.split("token", " ", 2)
    tokens = index_tokens(chunks).select(
        "tree_id",
        "pos",
        algebra.parse_col(F.nullif(pair[1], F.lit(CLOSE_TOKEN))).alias("value"),
        pair[0].cast("int").alias("said"),
    )
    tokens = materialize(tokens, "depth-tokens")
    if not validate_tokens(tokens).filter("not valid").isEmpty():
        raise ValueError("depth-annotated text: extra close or unclosed open")
    wrong = F.raise_error("depth-annotated text: a depth does not follow from the tokens before it").cast("int")
    depth = F.when(F.col("said") == F.col("depth"), F.col("depth")).otherwise(wrong)
    return token_depth(tokens).select("tree_id", "pos", "value", depth.alias("depth"))
