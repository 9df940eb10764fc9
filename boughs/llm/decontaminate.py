"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``WINDOW`` consecutive words (a shorter item is one window). A
window is contained in a document if its words occur there one after the other. As containment is exact,
the prefix that any containing document must share has a single token: the window's rarest shingle, with
shingles ordered by how often they occur in the corpus. So each window is joined on one shingle only.

The corpus is read once. Positions whose shingle may belong to the benchmark pass a bit filter of fixed size
(``FILTER_BITS``, built by an aggregation) and are written with the words around them. Their counts give
the order; the join on the rarest shingle, the position and length bounds and the comparison of all words
with the window run as DataFrame operations on these positions alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .words import same

WINDOW, SHINGLE = 10, 5
#: bits of the filter: 2 MiB at most, however large the benchmark is
FILTER_BITS = 24
_MIX = np.uint64(0x9E3779B97F4A7C15)

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c if c >= 0x80 or c in _KEEP else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def item_words(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return (text or b"").translate(_TABLE).split()


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words."""
    total = max(len(hashes) - n + 1, 0)
    out = np.full(total, n, np.uint64)
    for i in range(n):
        out = (out ^ hashes[i : i + total]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


_WINDOWS = "item_id {}, words array<string>, n int, shingles array<struct<shift:int,h:bigint>>"


def _item_windows(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, rows = batch.column(0), batch.column(1).cast(pa.large_binary()), []
            for item, text in zip(ids, texts):
                found = item_words(text.as_py())
                length = min(window, len(found))
                n = min(shingle, length)
                hashes = shingle_hashes(_word_hashes(found), n).view(np.int64) if n else []
                for i in range(len(found) - length + 1 if length else 0):
                    part = [{"shift": j, "h": int(h)} for j, h in enumerate(hashes[i : i + length - n + 1])]
                    rows.append((item.as_py(), [w.decode() for w in found[i : i + length]], n, part))
            kinds = [
                batch.schema.field(0).type,
                pa.list_(pa.string()),
                pa.int32(),
                pa.list_(pa.struct([("shift", pa.int32()), ("h", pa.int64())])),
            ]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "words", "n", "shingles"])

    return run


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per window of each item: its words, and its shingles of ``n`` words with their place."""
    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(_item_windows(window, shingle), _WINDOWS.format(kind))


def _bit_filter(windows: DataFrame, bits: int) -> tuple[list[int], np.ndarray]:
    """Lengths of shingles in use (at most ``SHINGLE`` of them) and a bit for each shingle hash."""
    slots = windows.select(F.explode("shingles.h").alias("h")).select(F.shiftrightunsigned("h", 64 - bits).alias("slot"))
    hashed = slots.selectExpr("shiftright(slot, 6) at", "shiftleft(1L, int(slot % 64)) bit")
    table = np.zeros(1 << (bits - 6), np.uint64)
    found = hashed.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return sorted(r.n for r in windows.select("n").distinct().collect()), table


def _occurrences(lengths: list[int], bits: int, window: int, shared):
    """For each document its word count and the places that may hold a benchmark shingle, with context."""
    place = pa.struct([("pos", pa.int32()), ("h", pa.int64()), ("first", pa.int32()), ("near", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            counts, places = [], []
            for text in batch.column("__text").cast(pa.large_binary()):
                found = item_words(text.as_py())
                counts.append(len(found))
                hashes, rows = _word_hashes(found), []
                for n in lengths:
                    h = shingle_hashes(hashes, n)
                    slot = h >> np.uint64(64 - bits)
                    hit = np.flatnonzero((table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
                    for i in hit:
                        first = max(int(i) - window + n, 0)
                        near = [w.decode() for w in found[first : int(i) + window]]
                        rows.append({"pos": int(i), "h": int(h[i].view(np.int64)), "first": first, "near": near})
                places.append(rows)
            columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "__text"]
            names = [c for c in batch.schema.names if c != "__text"]
            columns += [pa.array(counts, pa.int64()), pa.array(places, pa.list_(place))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "places"])

    return run


def contamination(
    docs: DataFrame,
    items: DataFrame,
    keys: list[str],
    text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    bits: int = FILTER_BITS,
) -> DataFrame:
    """``keys, n_words, n_hit, items`` for every row of ``docs``; ``items`` are the distinct item ids, sorted.

    NULL and empty texts have no words; such items have no window. Items without an id are matched and their
    words are hit, but they are not listed. Equal items are all listed, and a document row that comes twice is
    reported twice. Without any window in ``items`` nothing is hit.
    """
    spark = docs.sparkSession
    ship_package(spark)
    windows = materialize(item_windows(items, window, shingle), "windows")
    lengths, table = _bit_filter(windows, bits)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    places = "array<struct<pos:int,h:bigint,first:int,near:array<string>>>"
    base = docs.select(*keys, F.col(text).alias("__text")).mapInArrow(
        _occurrences(lengths, bits, window, spark.sparkContext.broadcast(table)),
        f"{kinds}, n_words bigint, places {places}",
    )
    # the row number is fixed by writing it
    base = materialize(base.withColumn("__row", F.monotonically_increasing_id()), "places")
    found = base.filter(F.size("places") > 0).select("__row", "n_words", F.explode("places").alias("p"))
    found = found.select("__row", "n_words", "p.*")

    counts = found.groupBy("h").agg(F.count("*").alias("often"))
    shingles = windows.groupBy("words").agg(F.first("shingles").alias("shingles"))  # equal words, equal shingles
    ranked = shingles.select("words", F.size("shingles").alias("need"), F.explode("shingles").alias("s"))
    ranked = ranked.select("words", "need", "s.*").join(counts, "h")
    rarest = ranked.groupBy("words", "need").agg(
        F.count("*").alias("present"), F.min(F.struct("often", "h", "shift")).alias("r")
    )
    prefix = rarest.filter("present = need").select("words", F.size("words").alias("length"), "r.h", "r.shift")

    met = found.join(prefix, "h").withColumn("start", F.col("pos") - F.col("shift"))
    met = met.filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
    at = F.col("start") - F.col("first") + 1
    exact = met.filter((at >= 1) & (F.slice("near", F.greatest(at, F.lit(1)), F.col("length")) == F.col("words")))
    hits = materialize(exact.select("__row", "start", "length", "words").distinct(), "hits")

    before = Window.partitionBy("__row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    spans = hits.select("__row", "start", "length").distinct().withColumn("reach", F.max(end).over(before))
    fresh = F.greatest(end - F.greatest("start", F.coalesce("reach", F.lit(0))), F.lit(0))
    covered = spans.groupBy("__row").agg(F.sum(fresh).alias("n_hit"))
    listed = windows.filter("item_id is not null").select("words", "item_id").distinct()
    named = hits.select("__row", "words").distinct().join(listed, "words").select("__row", "item_id").distinct()
    named = named.groupBy("__row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    none = F.array().cast(named.schema["items"].dataType)
    out = base.drop("places").join(covered, "__row", "left").join(named, "__row", "left")
    return out.select(
        *keys,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", none).alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs."""
    hashed = docs.withColumn("__h", F.xxhash64(text))
    dirty = contamination(hashed, items, [key, "__h"], text).filter("n_hit > 0")
    dirty = dirty.select(F.col(key).alias("__id"), F.col("__h").alias("__hh")).distinct()
    clean = hashed.join(dirty, same(F.col(key), F.col("__id")) & (F.col("__h") == F.col("__hh")), "left_anti")
    return clean.select(*docs.columns)
