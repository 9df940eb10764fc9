"""Exact k-means over dictionary-encoded vectors.

Vectors are whole numbers, cut into blocks of ``width`` dimensions. The distinct subvectors of a block form its
dictionary, and a vector is stored as one code per block, from which it can be rebuilt exactly. A round computes
the squared distance of every dictionary entry to every centroid once, and the distance of a vector is the sum of
the partial distances of its codes. Sums for new centroids are counts of codes, weighted by their subvectors.

The dictionaries together hold at most ``DICTIONARY`` subvectors, the most frequent ones. A vector with a subvector
outside keeps its whole numbers beside its codes, and that block is computed from them, so results are exact for any
data. Dictionary and centroids are all that tasks are sent; a round returns one sum per cluster and dimension.

Defined results: only vectors with exactly ``dims`` components, none of them null or not finite, are kept; an empty
table gives no rows; repeated rows are vectors of their own; a null id takes part, but starts a centroid only after all
others. With fewer than ``k`` vectors there are fewer centroids. Only the key columns are carried, so other columns
may have any name but those of the result. A component beyond +-2**27 raises, since distances would leave BIGINT.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: dimensions of a block
WIDTH = 2
#: dictionary entries of all blocks together, the size of what is sent to tasks
DICTIONARY = 1 << 18
LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, keys: list[str], column: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``keys, __q``: kept vectors as ``floor(scale * x)``."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(scale)))
    wide = F.exists("__q", lambda x: F.abs(x) > LARGEST)
    rows = vectors.filter((F.size(column) == dims) & fine).select(*keys, whole.alias("__q"))
    too_wide = F.raise_error("a component is too large for exact distances")
    return rows.withColumn("__q", F.when(wide, too_wide).otherwise(F.col("__q")))


@dataclass
class Block:
    """Dictionary of one block: ``subs`` in lexicographic order, looked up one dimension at a time."""

    first: int
    subs: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, first: int, subs: np.ndarray) -> Block:
        subs = subs[np.lexsort(subs.T[::-1])]
        code, levels = np.zeros(len(subs), np.int64), []
        for x in subs.T:
            values, at = np.unique(x, return_inverse=True)
            prefixes, code = np.unique(code * len(values) + at, return_inverse=True)
            levels.append((values, prefixes))
        return cls(first, subs, levels)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Code of each row of ``x``; -1 outside the dictionary."""
        code = np.zeros(len(x), np.int64)
        if not len(self.subs):
            return code - 1
        known = np.ones(len(x), bool)
        for (values, prefixes), column in zip(self.levels, x.T):
            at = np.minimum(np.searchsorted(values, column), len(values) - 1)
            known &= values[at] == column
            key = code * len(values) + at
            code = np.minimum(np.searchsorted(prefixes, key), len(prefixes) - 1)
            known &= prefixes[code] == key
        return np.where(known, code, -1)


@dataclass
class Codebook:
    """Dictionaries of all blocks; an entry's number is its block's offset plus its code."""

    blocks: list[Block]
    offsets: np.ndarray

    def encode(self, q: np.ndarray) -> np.ndarray:
        out = np.empty((len(q), len(self.blocks)), np.int32)
        for b, block in enumerate(self.blocks):
            code = block.codes(q[:, block.first : block.first + block.subs.shape[1]])
            out[:, b] = np.where(code < 0, -1, code + self.offsets[b])
        return out

    def partial_distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distance of every entry to the same dimensions of every centroid, with a last row of zeros."""
        out = np.zeros((self.offsets[-1] + 1, len(centroids)), np.int64)
        for b, block in enumerate(self.blocks):
            near = centroids[:, block.first : block.first + block.subs.shape[1]]
            out[self.offsets[b] : self.offsets[b + 1]] = ((block.subs[:, None, :] - near[None]) ** 2).sum(axis=2)
        return out

    def distances(self, table: np.ndarray, centroids: np.ndarray, codes: np.ndarray, raw: dict[int, np.ndarray]) -> np.ndarray:
        out = np.zeros((len(codes), table.shape[1]), np.int64)
        for b in range(len(self.blocks)):
            out += table[codes[:, b]]  # code -1 is the row of zeros
        for row, q in raw.items():
            for b in np.flatnonzero(codes[row] < 0):
                own = slice(self.blocks[b].first, self.blocks[b].first + self.blocks[b].subs.shape[1])
                out[row] += ((q[own] - centroids[:, own]) ** 2).sum(axis=1)
        return out

    def sums(self, counts: np.ndarray, dims: int) -> np.ndarray:
        """Sum of vectors per cluster from the counts of entry by cluster."""
        out = np.zeros((counts.shape[1], dims), np.int64)
        for b, block in enumerate(self.blocks):
            own = counts[self.offsets[b] : self.offsets[b + 1]]
            out[:, block.first : block.first + block.subs.shape[1]] = own.T @ block.subs
        return out


def learn_codebook(rows: DataFrame, dims: int = DIMS, width: int = WIDTH, limit: int = DICTIONARY) -> Codebook:
    """Distinct subvectors, counted with map-side combine; the most frequent ones if there are more than ``limit``."""
    firsts = list(range(0, dims, width))
    cut = [F.struct(F.lit(b).alias("b"), F.slice("__q", first + 1, width).alias("sub")) for b, first in enumerate(firsts)]
    counts = materialize(rows.select(F.inline(F.array(*cut))).groupBy("b", "sub").count(), "subvectors")
    power = F.floor(F.log2(F.col("count"))).cast("int")
    held, least = 0, 0
    for p, n in sorted(counts.groupBy(power.alias("p")).count().collect(), reverse=True):
        if held + n > limit:
            least = 1 << (p + 1)
            break
        held += n
    found = counts.filter(F.col("count") >= least).select("b", "sub").toArrow()
    block = found.column("b").to_numpy()
    lists = found.column("sub").combine_chunks()
    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    blocks = []
    for b, first in enumerate(firsts):
        w = min(width, dims - first)
        blocks.append(Block.of(first, flat[at[block == b][:, None] + np.arange(w)].astype(np.int64).reshape(-1, w)))
    return Codebook(blocks, np.concatenate([[0], np.cumsum([len(x.subs) for x in blocks])]))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def encode(rows: DataFrame, keys: list[str], book: Codebook, dims: int = DIMS) -> DataFrame:
    """``keys, __codes, __raw``; ``__raw`` has the whole vector where a subvector is not in the dictionary."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = book.encode(_matrix(batch.column("__q"), dims))
            stored = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(codes.shape[1] * 4), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes, "<i4"))]
            )
            known = pa.array(~(codes < 0).any(axis=1))
            raw = pc.if_else(known, pa.scalar(None, batch.column("__q").type), batch.column("__q"))
            columns = [*(batch.column(k) for k in keys), stored.cast(pa.binary()), raw]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "__codes", "__raw"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.mapInArrow(run, f"{kinds}, __codes binary, __raw array<bigint>")


def _assigned(batch: pa.RecordBatch, book: Codebook, table: np.ndarray, centroids: np.ndarray):
    stored = b"".join(batch.column("__codes").to_pylist())
    codes = np.frombuffer(stored, "<i4").reshape(batch.num_rows, len(book.blocks))
    lists = batch.column("__raw")
    raw = {int(i): np.array(lists[int(i)].as_py()) for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))}
    far = book.distances(table, centroids, codes, raw)
    cluster = far.argmin(axis=1)  # the first of equal ones
    return codes, raw, cluster, far[np.arange(len(far)), cluster]


def _round(coded: DataFrame, book: Codebook, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = book.partial_distances(centroids)
        counts, n, extra = np.zeros((len(table), k), np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            codes, raw, cluster, _ = _assigned(batch, book, table, centroids)
            n += np.bincount(cluster, minlength=k)
            at = np.where(codes < 0, len(table) - 1, codes) * k + cluster[:, None]
            counts += np.bincount(at.ravel(), minlength=counts.size).reshape(counts.shape)
            for row, q in raw.items():
                for b in np.flatnonzero(codes[row] < 0):
                    own = slice(book.blocks[b].first, book.blocks[b].first + book.blocks[b].subs.shape[1])
                    extra[cluster[row], own] += q[own]
        full = np.flatnonzero(n)
        sums = (book.sums(counts, dims) + extra)[full]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * dims), pa.array(sums.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n[full]), lists], ["c", "n", "sums"])

    parts = coded.drop(*[c for c in coded.columns if not c.startswith("__")]).mapInArrow(run, "c int, n bigint, sums array<bigint>")
    totals = parts.select("c", "n", F.posexplode("sums")).groupBy("c", "pos").agg(
        F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s")
    )
    moved = centroids.copy()
    for c, pos, n, s in totals.collect():  # one row per cluster and dimension
        moved[c, pos] = int(s) // n
    return moved


def first_centroids(rows: DataFrame, key: str, k: int = CLUSTERS, dims: int = DIMS) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``1:<key>``; equal ones in the order of their components."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col(key).cast("string")), 256)
    found = rows.select(digest.alias("h"), "__q").orderBy(F.asc_nulls_last("h"), "__q").limit(k).collect()
    return np.array([r["__q"] for r in found], np.int64).reshape(-1, dims)


def cluster_vectors(
    vectors: DataFrame,
    keys: list[str],
    column: str = "embedding",
    dims: int = DIMS,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    limit: int = DICTIONARY,
) -> DataFrame:
    """``keys, cluster, distance, cluster_inertia, inertia, centroid`` for every kept vector; see the module's text.

    ``centroid`` is the array of the final centroid's components, ``distance`` the squared distance to it.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, keys, column, dims, scale)
    book, centroids = learn_codebook(rows, dims, width, limit), first_centroids(rows, keys[0], k, dims)
    coded = materialize(encode(rows, keys, book, dims), "coded")
    for _ in range(rounds if len(centroids) else 0):
        centroids = _round(coded, book, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = book.partial_distances(centroids)
        for batch in batches:
            _, _, cluster, far = _assigned(batch, book, table, centroids)
            columns = [*(batch.column(c) for c in keys), pa.array(cluster.astype(np.int32)), pa.array(far)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "cluster", "distance"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.select(*keys).schema)
    out = materialize(coded.mapInArrow(run, f"{kinds}, cluster int, distance bigint"), "assigned")
    inertia = dict(out.groupBy("cluster").agg(F.sum("distance")).collect())
    total = sum(inertia.values())
    facts = [(c, n, total, centroids[c].tolist()) for c, n in sorted(inertia.items())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return out.join(F.broadcast(facts), "cluster").select(
        *keys, "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )


def centroid_digest(centroid: str = "centroid"):
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)
