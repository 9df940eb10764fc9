"""Token text read by byte ranges, so that a tree in one line of any length is spread over tasks.

A line is a row for Spark's text source, and a row must fit a task. Here files are only listed; each task reads byte ranges
and cuts them at blanks and line ends. A token belongs to the range that holds its first byte, so every range is read on
its own, and chunk numbers follow from byte offsets without a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .text import _in_path_order

#: bytes of one read, and of one chunk
RANGE_BYTES, CHUNK_BYTES = 8 << 20, 1 << 17
#: bytes read at a time to find the end of the last token of a range
TAIL_BYTES = 1 << 12
#: ranges of a file that one row may list
_LISTED = 1 << 12
_PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")

_IS_GAP = np.zeros(256, dtype=bool)
_IS_GAP[[ord(" "), ord("\n"), ord("\r")]] = True


def _open(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, name = fs.FileSystem.from_uri(quote(path, safe="/:@[]%"))
    return system.open_input_file(name)


def _bytes_of(file: pa.NativeFile, start: int, end: int) -> np.ndarray:
    """Bytes from ``start`` to the end of the last token that begins before ``end``; a token begun earlier is blanked."""
    size = file.size()
    end = min(end, size)
    lead = 1 if start else 0
    parts = [np.frombuffer(file.read_at(end - start + lead, start - lead), np.uint8)]
    while end < size and not _IS_GAP[parts[-1][-1]]:
        more = np.frombuffer(file.read_at(TAIL_BYTES, end), np.uint8)
        gaps = np.flatnonzero(_IS_GAP[more])
        end += len(more)
        parts.append(more[: gaps[0] + 1] if len(gaps) else more)
    data = np.concatenate(parts)
    if lead:
        if not _IS_GAP[data[0]]:
            gaps = np.flatnonzero(_IS_GAP[data])
            data[: gaps[0] if len(gaps) else len(data)] = ord(" ")
        data = data[1:]
    return data


def _chunks_of(data: np.ndarray, chunk_bytes: int) -> tuple[np.ndarray, pa.ListArray]:
    """Numbers (from 0) of the chunks that hold tokens, and their tokens."""
    kept = ~_IS_GAP[data]
    edge = np.diff(np.concatenate([[False], kept, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[kept].tobytes()))
    words.validate(full=True)
    numbers, first = np.unique(begin // chunk_bytes, return_index=True)
    return numbers, pa.ListArray.from_arrays(pa.array(np.append(first, len(begin)).astype(np.int32)), words)


def read_token_ranges(
    spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Token text of any line length -> chunk table ``(tree_id, chunk_id, tokens)``.

    Files in folders ``tree_id=N`` belong to tree N, all others to tree 0; the files of a tree follow in path order. Tokens
    are parted by blanks and line ends. Chunks without a token have no row, so chunk numbers ascend but may have gaps. A token
    must fit a task. Compressed files cannot be read by ranges and raise, as does text that is not UTF-8. ``range_bytes`` is
    rounded to whole chunks.
    """
    per_range = max(range_bytes // chunk_bytes, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tree, name, base, n in zip(*(b.column(i).to_pylist() for i in range(4))):
                at = n * per_range * chunk_bytes
                with _open(name) as file:
                    numbers, tokens = _chunks_of(_bytes_of(file, at, at + per_range * chunk_bytes), chunk_bytes)
                ids = pa.array(numbers + (base + n * per_range), pa.int64())
                trees = pa.array(np.full(len(ids), tree), pa.int64())
                yield pa.RecordBatch.from_arrays([trees, ids, tokens], names=["tree_id", "chunk_id", "tokens"])

    ship_package(spark)
    files = spark.read.format("binaryFile").load(path)
    tree = F.col("tree_id").cast("bigint") if "tree_id" in files.columns else F.lit(0).cast("bigint")
    files = files.filter("length > 0").select(tree.alias("tree_id"), F.col("path").alias("file"), "length")
    packed = F.lower("file").rlike("(" + "|".join(s.replace(".", "[.]") for s in _PACKED) + ")$")
    refused = F.raise_error(F.concat(F.lit("compressed text has no byte ranges: "), "file")).cast("string")
    files = files.withColumn("file", F.when(packed, refused).otherwise(F.col("file")))
    counted = files.withColumn("n_file", F.ceil(F.col("length") / chunk_bytes))
    order = _in_path_order(counted.select("file", "n_file"))
    placed = counted.join(order.select("file", "lines_before"), "file")
    firsts = placed.groupBy("tree_id").agg(F.min("lines_before").alias("first"))
    placed = placed.join(firsts, "tree_id").select(
        "tree_id", "file", (F.col("lines_before") - F.col("first")).alias("base"),
        F.ceil(F.col("n_file") / per_range).alias("n_ranges"),
    )
    listed = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n_ranges - 1) div {_LISTED}"))))
    low = F.col("part") * _LISTED
    listed = listed.select(
        "tree_id", "file", "base", F.explode(F.sequence(low, F.least(low + _LISTED, F.col("n_ranges")) - 1)).alias("n")
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return listed.repartition(tasks, "file", "n").mapInArrow(run, "tree_id bigint, chunk_id bigint, tokens array<string>")
