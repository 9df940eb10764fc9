"""Bigram counts of a whole corpus, without a bound on words or bigrams.

Documents are packed into blocks of about ``BLOCK`` words (one written row each: the block's own words as 64-bit
hashes, and its texts as numbers of these words). A block asks each *bucket* of words for the counts of its distinct
bigrams, one row per block and bucket; a bucket adds up what all blocks sent and answers in the order of each request.
So neither the driver nor a task ever holds the model: a task holds one block or one bucket, and the number of both
grows with the input. A bigram lives in the bucket of its first word; hot first words (a bounded list) are dealt
over all buckets by their second word, and their sums are added up and broadcast.

Words are compared by their 64-bit hash.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package

SEED = 42
#: words of a block, and words of the corpus per bucket
BLOCK, BUCKET = 1 << 19, 1 << 20
#: bytes of text that are split at once
SLICE = 1 << 22
#: a word is hot if it holds more than this part of a bucket
HOT_PART = 8


def _pack(values: np.ndarray) -> bytes:
    """Non-negative numbers in the fewest bytes that fit all of them."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _press(values: np.ndarray) -> bytes:
    """Byte planes, compressed: frequent words have small numbers, so the high planes shrink to little."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _release(data: bytes) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in order, and the number of words of each; only A-Z change, only ASCII spaces part words."""
    # copied: Arrow's string kernels misread the cast of a slice
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    sizes, found = pc.list_value_length(lists).to_numpy(), lists.flatten()
    full = pc.not_equal(found, "")
    of = np.repeat(np.arange(len(sizes)), sizes)[full.to_numpy(zero_copy_only=False)]
    return found.filter(full), np.bincount(of, minlength=len(sizes))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = pc.fill_null(pc.binary_length(batch.column("__text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _packer(keys: list[str], near: int):
    """One row per block; a block ends with its task at the latest."""

    def row(words: list[pa.Array], sizes: list[np.ndarray], held: list[pa.RecordBatch]) -> pa.RecordBatch:
        coded = pa.concat_arrays(words).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        n = np.bincount(codes, minlength=len(coded.dictionary))
        order = np.argsort(-n, kind="stable")  # frequent words get small numbers
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(n)
        )
        hashes, codes, n = hashes[order], place[codes], n[order]
        often = n * 1000 > len(codes)
        fields = [pa.concat_arrays([b.column(k) for b in held]) for k in keys]
        names = pa.StructArray.from_arrays(fields, names=keys).slice(0, 0 if near else None)
        columns = [
            pa.array([uuid.uuid4().int >> 65], pa.int64()),
            pa.array([near], pa.int32()),
            pa.array([len(codes)], pa.int64()),
            pa.array([hashes.tobytes()]),
            pa.array([_press(codes)]),
            pa.array([_pack(np.concatenate(sizes))]),
            pa.array([hashes[often].view(np.int64).tolist()], pa.list_(pa.int64())),
            pa.array([n[often].tolist()], pa.list_(pa.int64())),
            pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
        ]
        named = ["block", "near", "size", "words", "codes", "sizes", "often", "often_n", "keys"]
        return pa.RecordBatch.from_arrays(columns, names=named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sizes, held, n = [], [], [], 0
        for batch in batches:
            for part in _slices(batch):
                found, size = split_words(part.column("__text"))
                words.append(found)
                sizes.append(size)
                held.append(part.select(keys))
                n += len(found)
                if n >= BLOCK:
                    yield row(words, sizes, held)
                    words, sizes, held, n = [], [], [], 0
        if held:
            yield row(words, sizes, held)

    return run


class Block:
    """Distinct bigrams of a block, and the order in which they go to the buckets.

    An *entry* is a word in its home bucket, or a hot word in a bucket that gets bigrams of it; ``runs`` is the number
    of bigrams after each entry.
    """

    def __init__(self, words: bytes, codes: bytes, sizes: bytes, hot: np.ndarray, buckets: int):
        self.words = np.frombuffer(words, np.uint64)
        self.codes = _release(codes)
        self.sizes = _unpack(sizes)
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.inner = np.flatnonzero(self.of[1:] == self.of[:-1]) + 1  # words with a word before them
        pairs = self.codes[self.inner - 1] << 32 | self.codes[self.inner]
        pairs, self.which = np.unique(pairs, return_inverse=True)
        head, tail = pairs >> 32, pairs & 0xFFFFFFFF
        k = np.uint64(buckets)
        home = (_mix(self.words) % k).astype(np.int64)
        self.hot = np.isin(self.words, hot)
        dealt = (_mix(self.words[head] ^ _mix(self.words[tail] + np.uint64(1))) % k).astype(np.int64)
        bucket = np.where(self.hot[head], dealt, home[head])
        # an entry is bucket, hot flag, word; entries of homes and of dealt hot words never coincide
        self.bits = max(1, len(self.words)).bit_length() + 1
        kind = self.hot.astype(np.int64) << (self.bits - 1)
        mine = bucket << self.bits | kind[head] | head
        entries = np.concatenate([home << self.bits | np.arange(len(self.words)), np.unique(mine)])
        self.entries = np.unique(entries)
        self.order = np.argsort(mine, kind="stable")
        self.head, self.tail, self.bucket = head, tail, bucket[self.order]
        self.runs = np.diff(np.searchsorted(mine[self.order], np.append(self.entries, np.iinfo(np.int64).max)))
        self.entry_bucket = self.entries >> self.bits
        self.entry_word = self.entries & ((1 << (self.bits - 1)) - 1)
        self.at_home = self.entries >> (self.bits - 1) & 1 == 0

    def requests(self, near: int, trusted: list[int]) -> Iterator[tuple[int, *tuple[bytes, ...]]]:
        """Counts per bucket; a block of the target (``near``) counts for the target only, else its ``trusted`` texts do."""
        mark = np.full(len(self.sizes), near, bool)
        mark[trusted] = True
        mark = mark[self.of]
        uni, n = [], []
        for used in (np.full(len(mark), not near), mark):
            word = np.bincount(self.codes[used], minlength=len(self.words))
            uni.append(np.where(self.at_home, word[self.entry_word], 0))
            n.append(np.bincount(self.which[used[self.inner]], minlength=len(self.head))[self.order])
        tail = self.words[self.tail[self.order]]
        found = np.unique(self.entry_bucket)
        cut, cut2 = (np.searchsorted(x, np.append(found, np.iinfo(np.int64).max)) for x in (self.entry_bucket, self.bucket))
        words = self.words[self.entry_word]
        for i, b in enumerate(found):
            e, p = slice(cut[i], cut[i + 1]), slice(cut2[i], cut2[i + 1])
            counts = [_pack(uni[0][e]), _pack(uni[1][e]), _pack(n[0][p]), _pack(n[1][p])]
            yield int(b), words[e].tobytes(), _pack(self.runs[e]), tail[p].tobytes(), *counts


FACTS = 6  # of an entry: count, count as first word and different next words, each of background and target


def _requester(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, buckets = shared.value
        names = ["bucket", "block", "near", "words", "runs", "tails", "uni0", "uni1", "n0", "n1"]
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                block = Block(r["words"], r["codes"], r["sizes"], hot, buckets)
                rows = [(b, r["block"], r["near"], *x) for b, *x in block.requests(r["near"], r["trusted"] or [])]
                if rows:
                    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _adder(shared):
    """Adds up a bucket and answers every request of the background."""

    def run(table: pa.Table) -> pa.Table:
        hot, buckets = shared.value
        cells = table.to_pydict()
        words, tails = ([np.frombuffer(x, np.uint64) for x in cells[c]] for c in ("words", "tails"))
        runs, *counts = (np.concatenate([_unpack(x) for x in cells[c]]) for c in ("runs", "uni0", "uni1", "n0", "n1"))
        near = np.array(cells["near"])
        ends, pair_ends = (np.cumsum([0, *[len(y) for y in x]]) for x in (words, tails))
        distinct, entry = np.unique(np.concatenate(words), return_inverse=True)
        head = np.repeat(entry, runs)
        second, tail = np.unique(np.concatenate(tails), return_inverse=True)
        pairs, pair = np.unique(head * max(1, len(second)) + tail, return_inverse=True)
        first = pairs // max(1, len(second))
        facts, both = [], []
        for side in (0, 1):
            here, total, word, kinds = (np.zeros(n, np.int64) for n in (len(pairs), *[len(distinct)] * 3))
            np.add.at(here, pair, counts[2 + side])
            np.add.at(word, entry, counts[side])
            np.add.at(total, first, here)
            np.add.at(kinds, first[here > 0], 1)
            facts += [word, total, kinds]
            both.append(here)
        out = []
        for i in np.flatnonzero(near == 0):
            e, p = entry[ends[i] : ends[i + 1]], pair[pair_ends[i] : pair_ends[i + 1]]
            out.append((cells["block"][i], cells["bucket"][i], [_pack(f[e]) for f in facts], *(_pack(b[p]) for b in both), []))
        home = _mix(distinct) % np.uint64(buckets) == cells["bucket"][0]
        out.append((None, None, None, None, None, [[0, int((facts[0] + facts[3] > 0)[home].sum()), facts[0].sum(), facts[3].sum(), 0, 0]]))
        for j in np.flatnonzero(np.isin(distinct, hot)):
            out[-1][-1].append([1, int(distinct[j].view(np.int64)), *(int(facts[k][j]) for k in (1, 2, 4, 5))])
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
        names = ["block", "bucket", "facts", "far", "near", "sums"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def _losses(block: Block, facts: list[np.ndarray], counts: np.ndarray, hot: dict, side: int, words: int, total: int):
    """Loss of every document of the block under one model."""
    uni, first, kinds = (np.zeros(len(block.words), np.int64) for _ in range(3))
    home = block.at_home
    for to, what in ((uni, 0), (first, 1), (kinds, 2)):
        to[block.entry_word[home]] = facts[3 * side + what][home]
    for i in np.flatnonzero(block.hot):
        first[i], kinds[i] = hot.get(int(block.words[i].view(np.int64)), (0,) * 4)[2 * side : 2 * side + 2]
    p = (uni + 1) / (total + words + 1)
    n = np.empty(len(counts), np.int64)
    n[block.order] = counts
    seen = (first + kinds)[block.head]
    back, seen = np.where(seen > 0, kinds[block.head], 1), np.where(seen > 0, seen, 1)
    pair = -np.log((n + back * p[block.tail]) / seen)
    each = -np.log(p)[block.codes]
    each[block.inner] = pair[block.which]
    return np.bincount(block.of, weights=each, minlength=len(block.sizes)) / np.maximum(block.sizes, 1)


def _scorer(keys: list[str], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words, buckets, hot, words, far, near = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("words", "codes", "sizes", "answers")}
                block = Block(r["words"], r["codes"], r["sizes"], hot_words, buckets)
                answers = sorted(r["answers"] or [], key=lambda a: a["bucket"])
                empty = [np.empty(0, np.int64)]
                facts = [np.concatenate(empty + [_unpack(a["facts"][k]) for a in answers]) for k in range(FACTS)]
                counts = [np.concatenate(empty + [_unpack(a[c]) for a in answers]) for c in ("far", "near")]
                losses = [_losses(block, facts, counts[s], hot, s, words, n) for s, n in ((0, far), (1, near))]
                if not near:  # nothing is trusted: the target is the background
                    losses[1] = losses[0]
                names = batch.column("keys").slice(i, 1).flatten()
                columns = [*names.flatten(), pa.array(block.sizes), pa.array(losses[1]), pa.array(losses[0])]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "n_tokens", "target_loss", "background_loss"])

    return run


def losses_by_tables(
    docs: DataFrame, target: DataFrame | None, keys: list[str], text: str, trusted: DataFrame | None = None
) -> DataFrame:
    """``keys, n_tokens, target_loss, background_loss`` for every row of ``docs``.

    The target is a table of texts, or the rows of ``docs`` whose first key is in ``trusted`` (one column, no key
    twice): then only keys are joined, never texts.
    """
    spark = docs.sparkSession
    ship_package(spark)
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    kinds = (
        "block bigint, near int, size bigint, words binary, codes binary, sizes binary, often array<bigint>, "
        f"often_n array<bigint>, keys array<struct<{fields}>>"
    )
    blocks = docs.select(*keys, F.col(text).alias("__text")).mapInArrow(_packer(keys, 0), kinds)
    if target is not None:
        # the keys of the target are not used, so they need not exist
        bare = target.select(*[F.lit(None).cast(docs.schema[k].dataType).alias(k) for k in keys], F.col(text).alias("__text"))
        blocks = blocks.unionByName(bare.mapInArrow(_packer(keys, 1), kinds))
    blocks = materialize(blocks, "lm-blocks")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET))
    often = blocks.select(F.explode(F.arrays_zip("often", "often_n")).alias("o")).groupBy("o.often").agg(F.sum("o.often_n").alias("n"))
    # at most HOT_PART * buckets words are that frequent
    hot = often.filter(F.col("n") * HOT_PART * buckets > total).collect() if buckets > 1 else []
    hot_words = np.array([r.often for r in hot], np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast((hot_words, buckets))

    asking = blocks.select("block", "near", "words", "codes", "sizes")
    if trusted is None:
        asking = asking.withColumn("trusted", F.lit(None).cast("array<int>"))
    else:
        rows = blocks.select("block", F.posexplode("keys").alias("i", "k")).select("block", "i", F.col("k")[keys[0]].alias("__key"))
        # labels grow with the corpus, so this is a shuffle join at every size
        good = rows.join(trusted.select(F.col(trusted.columns[0]).alias("__key")).hint("merge"), "__key")
        marks = materialize(good.groupBy("block").agg(F.sort_array(F.collect_list("i")).alias("trusted")), "lm-marks")
        asking = asking.join(marks, "block", "left")
    cells = "bucket int, block bigint, near int, words binary, runs binary, tails binary, uni0 binary, uni1 binary, n0 binary, n1 binary"
    cells = asking.mapInArrow(_requester(shared), cells)
    answers = "block bigint, bucket int, facts array<binary>, far binary, near binary, sums array<array<bigint>>"
    answers = materialize(cells.groupBy("bucket").applyInArrow(_adder(shared), answers), "lm-answers")

    sums = answers.select(F.explode("sums").alias("s"))
    words, far, near = (x or 0 for x in sums.filter("s[0] = 0").agg(*[F.sum(F.col("s")[i]) for i in (1, 2, 3)]).first())
    heads = sums.filter("s[0] = 1").groupBy(F.col("s")[1].alias("h")).agg(*[F.sum(F.col("s")[i]) for i in (2, 3, 4, 5)]).collect()
    model = spark.sparkContext.broadcast((hot_words, buckets, {r[0]: tuple(r)[1:] for r in heads}, words, far, near))

    mine = blocks.filter("near = 0").select("block", "words", "codes", "sizes", "keys")
    told = answers.filter("block is not null").groupBy("block")
    told = told.agg(F.collect_list(F.struct("bucket", "facts", "far", "near")).alias("answers"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    return mine.join(told, "block", "left").drop("block").mapInArrow(
        _scorer(keys, model), f"{out}, n_tokens bigint, target_loss double, background_loss double"
    )
