"""SimHash near-dedup with pigeonring filtering.

A text's fingerprint is the bitwise majority over the 64-bit hashes of its word shingles. Two fingerprints
link if they differ in at most ``threshold`` bits. Links are found by the pigeonring principle: cut the 64
bits into ``threshold + 1`` segments on a ring. If two fingerprints differ in at most ``threshold`` bits, some
segment starts a chain whose first 1, 2, 3 ... segments together differ in at most 0, 1, 2 ... bits (the
proportional budget, rounded down). So the first segment is equal; the second differs in at most one bit, so
one of its halves is equal; the third in at most two, so one of its thirds is equal. Each choice of start,
half and third is one index table, and fingerprints meet in a bucket if these bits are equal. Inside a
bucket the cumulative budgets of the chain prune pairs before the full Hamming distance is taken.

Only distinct fingerprints are indexed, so copies cost nothing. A bucket of more than ``BLOCK`` fingerprints
is cut into blocks, and every pair of blocks is compared in a task of its own. A bucket reports a spanning
forest of its links, never all pairs, and a search compares a fingerprint only with those not reached yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .components import components

SHINGLE, THRESHOLD, CHAIN = 4, 4, 3
SEED = 42
#: fingerprints of a bucket that one task compares with as many others
BLOCK = 2048
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a UTF-8 text; a text without words has 0."""
    found = (text or b"").lower().split()  # bytes: only A-Z change, and only the six ASCII spaces part words
    if not found:
        return 0
    if len(found) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    ones, total = np.zeros((8, 8), np.int64), len(found) - shingle + 1
    for start in range(0, total, 1 << 16):
        part = found[start : start + (1 << 16) + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle)))
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64)
        for bit in range(8):  # eight byte lanes are summed at once; 255 ones fit a lane
            lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, np.arange(0, len(h), 255))
            ones[:, bit] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones.reshape(64) > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keys`` and ``fp`` (BIGINT holding the 64 bits) of every row."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").cast(pa.large_binary())
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            columns = [batch.column(k) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fp.view(np.int64))], names=[*keys, "fp"])

    rows = docs.select(*keys, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    return rows.mapInArrow(run, f"{kinds}, fp bigint")


def segments(threshold: int) -> list[int]:
    """Masks of the ``threshold + 1`` segments, the low bits first."""
    cuts = [round(64 * i / (threshold + 1)) for i in range(threshold + 2)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def _parts(mask: int, n: int) -> list[int]:
    bits = [i for i in range(64) if mask >> i & 1]
    cuts = [round(len(bits) * i / n) for i in range(n + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def chain_tables(threshold: int, chain: int) -> list[tuple[int, list[int]]]:
    """Index tables as (bits that must be equal, masks of the chain's first 2, 3 ... segments)."""
    ring, tables = segments(threshold), []
    m = len(ring)
    for start in range(m):
        keys, prefixes = [ring[start]], []
        for step in range(1, min(chain, m)):
            keys = [k | p for k in keys for p in _parts(ring[(start + step) % m], step + 1)]
            prefixes.append(sum(ring[(start + j) % m] for j in range(step + 1)))
        tables += [(k, prefixes) for k in keys]
    return tables


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(base: np.ndarray, others: np.ndarray, prefixes: list[int], threshold: int) -> np.ndarray:
    """Positions in ``others`` that link to ``base``: chain budgets first, the full distance last."""
    diff, at = others ^ base, np.arange(len(others))
    for budget, mask in enumerate(prefixes, 1):
        ok = np.bitwise_count(diff & np.uint64(mask)) <= budget
        diff, at = diff[ok], at[ok]
    return at[np.bitwise_count(diff) <= threshold]


def _forest(fps: np.ndarray, prefixes: list[int], threshold: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints, searched breadth first."""
    out, rest = [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            base = queue.pop()
            near = _near(base, rest, prefixes, threshold)
            if len(near):
                found = rest[near]
                out += [(int(base), int(x)) for x in found]
                queue += list(found)
                rest = np.delete(rest, near)
    return out


def _search(threshold: int, chain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = chain_tables(threshold, chain)
        for batch in batches:
            lists = batch.column("fps")
            offsets, fps = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            sizes, table = np.diff(offsets), batch.column("t").to_numpy()
            a, b = [], []
            for t in np.unique(table):
                prefixes = tables[t][1]
                two = offsets[:-1][(table == t) & (sizes == 2)]
                left, right = fps[two], fps[two + 1]  # most buckets: one pair each, all at once
                ok = _near(np.uint64(0), left ^ right, prefixes, threshold)
                a.append(left[ok])
                b.append(right[ok])
                for i in np.flatnonzero((table == t) & (sizes > 2)):
                    pairs = _forest(np.unique(fps[offsets[i] : offsets[i + 1]]), prefixes, threshold)
                    if pairs:
                        pairs = np.array(pairs, np.uint64)
                        a.append(pairs[:, 0])
                        b.append(pairs[:, 1])
            ends = [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], names=["a", "b"])

    return run


def pigeonring_links(
    fps: DataFrame, threshold: int = THRESHOLD, chain: int = CHAIN, block: int = BLOCK
) -> DataFrame:
    """Edges ``a, b`` that connect exactly the fingerprints within ``threshold`` bits of each other.

    ``fps`` holds distinct fingerprints in ``fp``. Longer chains give more index tables with smaller buckets.
    """
    ship_package(fps.sparkSession)
    tables = chain_tables(threshold, chain)
    keys = F.array(
        *[
            F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("v"))
            for t, (mask, _) in enumerate(tables)
        ]
    )
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.v")
    sizes = keyed.groupBy("t", "v").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(sizes, ["t", "v"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.filter(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (F.col("blocks") == 1) | (j != F.col("mine"))
    )
    met = met.withColumn("mine", mine).withColumn("other", F.explode(others))
    pair = [F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")]
    groups = met.select("t", "v", *pair, "fp").groupBy("t", "v", "x", "y").agg(F.collect_list("fp").alias("fps"))
    return groups.select("t", "fps").mapInArrow(_search(threshold, chain), "a bigint, b bigint").distinct()


def simhash_groups(
    docs: DataFrame,
    keys: list[str],
    text: str = "text",
    shingle: int = SHINGLE,
    threshold: int = THRESHOLD,
    chain: int = CHAIN,
) -> DataFrame:
    """``keys, fp, component_id``: the smallest first key reachable over links, for every row.

    NULL and empty texts have the fingerprint 0 and link like any other. Rows with a NULL first key take part;
    a component of only such rows has a NULL id. Repeated rows are listed as often as they come.
    """
    first = keys[0]
    rows = materialize(fingerprints(docs, keys, text, shingle), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min(first).alias("least")), "distinct-fp")
    linked = components(pigeonring_links(fps.select("fp"), threshold, chain))
    linked = linked.join(fps, linked["node"] == fps["fp"]).select("node", "root", "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("smallest"))
    named = linked.join(smallest, "root").select(F.col("node").alias("fp"), "smallest")
    named = fps.join(named, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"))
    # written, so that both sides of the last join are plain exchanges and a hot fingerprint can be split
    named = materialize(named, "components")
    return rows.join(named, "fp", "left").select(*keys, "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id.

    Rows that are equal in id and text are one document. In a group without any id, one text stays for each
    smallest text hash.
    """
    columns = docs.columns
    hashed = docs.withColumn("__h", F.xxhash64(text))
    rows = simhash_groups(hashed, [key, "__h"], text, **options)
    first = F.min(F.struct(F.col(key).isNull(), F.col(key).alias("id"), F.col("__h").alias("h"))).alias("f")
    # the component is named by its smallest id; groups of rows without an id are told apart by fingerprint
    name = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")))
    stay = rows.groupBy(name.alias("c")).agg(first).select(F.col("f.id").alias("__id"), F.col("f.h").alias("__hh"))
    kept = hashed.join(
        stay.distinct(), F.col(key).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hh")), "left_semi"
    )
    return kept.dropDuplicates([key, "__h"]).select(*columns)
