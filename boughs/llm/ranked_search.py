"""Ranked lexical search: Block-Max MaxScore over an inverted index in segments.

``build_index`` makes one pass over the documents. Every task cuts its rows into segments of about ``SEGMENT`` terms
and writes one row per term of a segment: its postings in blocks of ``BLOCK``, compressed (differences of document
numbers and term counts in 0, 1, 2 or 4 bytes each). A block's head keeps its last document and the pairs of term
count and document length that no other pair of the block beats in both. A score grows with the count and falls
with the length, so these pairs give the exact block maximum for any corpus statistics, and the index needs none.

``search`` gives each item its ``k`` best documents. Items go in batches, and a task scores a batch in one segment after
another with one heap per item, so later segments start with a high threshold. Lists are ordered by their global bound
(largest block maximum). Those whose bounds together stay below the threshold are non-essential: documents that
occur only there are never scored. A candidate from the essential lists is then looked up in the others, largest
bound first: if its score so far, the maximum of the block that could hold it and the bounds of the lists left stay
below the threshold, it is rejected before the block is decompressed. Heaps of all tasks are merged by a window.

Defined results: a null text has no terms and is not counted; an item without known terms has no rows; equal scores
rank by ascending id, a null id last; repeated rows are documents or items of their own; an empty table gives no rows;
a text of any length is one document of one segment. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grouped import group_heads, whole_groups
from ..session import materialize, ship_package

#: terms of a segment, postings of a block, items that a task scores together
SEGMENT, BLOCK, ITEMS = 1 << 21, 128, 256
TOP = 10
#: documents scored before an item has a threshold
FIRST_WINDOW = 256

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_FOLD = bytes(c if c in _WORD else c + 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for c in range(256))
_WIDTHS = np.array([0, 1, 2, 4])
_INDEX = "seg bigint, term binary, df bigint, n_words bigint, list binary, ids array<bigint>"


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text: letters, digits and everything beyond ASCII; only A-Z change."""
    return (text or b"").translate(_FOLD).split()


# ---- index ---------------------------------------------------------------------------------------


def _width_code(largest: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array([0, 0xFF, 0xFFFF]), largest)


def _put(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    for b in range(width):
        out[at + b] = (values >> (8 * b)) & 0xFF


def _frontier(block: np.ndarray, tf: np.ndarray, length: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Postings of each block that no other one beats in count and length: (their positions, blocks)."""
    order = np.lexsort((length, -tf, block))
    step = int(length.max(initial=0)) + 1
    sunk = length[order] + (n_blocks - 1 - block[order]) * step  # each block lies below the one before
    keep = np.ones(len(order), bool)
    keep[1:] = sunk[1:] < np.minimum.accumulate(sunk)[:-1]
    return order[keep], block[order[keep]]


def _move(out: np.ndarray, source: np.ndarray, source_ends: np.ndarray, to: np.ndarray) -> None:
    """Copy the pieces of ``source`` that end at ``source_ends`` to the places ``to``."""
    sizes = np.diff(source_ends, prepend=0)
    out[np.arange(len(source)) + np.repeat(to - (source_ends - sizes), sizes)] = source


def _posting_lists(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Terms, their document counts and their lists as bytes, for postings in order of (term, doc)."""
    n = len(term)
    head = np.flatnonzero(np.diff(term, prepend=-1))
    df = np.diff(np.append(head, n))
    place = np.arange(n) - np.repeat(head, df)
    start = np.flatnonzero(place % BLOCK == 0)
    count = np.diff(np.append(start, n))
    block = np.repeat(np.arange(len(start)), count)
    delta = doc.copy()
    delta[1:] -= np.where(term[1:] == term[:-1], doc[:-1], 0)
    doc_code, tf_code = (_width_code(np.maximum.reduceat(x, start)) for x in (delta, tf - 1))
    doc_width, tf_width = _WIDTHS[doc_code], _WIDTHS[tf_code]
    data_ends = np.cumsum(count * (doc_width + tf_width))
    data = np.zeros(int(data_ends[-1]), np.uint8)
    data_at = data_ends - count * (doc_width + tf_width)
    inside = np.arange(n) - start[block]
    for code, width in ((1, 1), (2, 2), (3, 4)):
        own = np.flatnonzero(doc_code[block] == code)
        _put(data, data_at[block[own]] + inside[own] * width, delta[own], width)
        own = np.flatnonzero(tf_code[block] == code)
        at = data_at + count * doc_width
        _put(data, at[block[own]] + inside[own] * width, tf[own] - 1, width)

    best, best_block = _frontier(block, tf, lengths[doc], len(start))
    front = np.column_stack([tf[best], lengths[doc[best]]]).astype("<u4")
    front_n = np.bincount(best_block, minlength=len(start))

    # a term's bytes: number of blocks, heads, frontiers, data; offsets count from the term's first block
    first = np.flatnonzero(np.isin(start, head))
    per_term = np.diff(np.append(first, len(start)))
    front_ends = np.cumsum(front_n)
    heads = np.column_stack(
        [
            doc[start + count - 1],
            data_at - np.repeat(data_at[first], per_term),
            front_ends - np.repeat((front_ends - front_n)[first], per_term),
            count | doc_code << 8 | tf_code << 10,
        ]
    ).astype("<u4")
    last = first + per_term - 1
    heads_ends, fronts_ends, datas_ends = np.cumsum(per_term) * 16, front_ends[last] * 8, data_ends[last]
    ends = 4 * np.arange(1, len(first) + 1) + heads_ends + fronts_ends + datas_ends
    begins = np.append(0, ends[:-1])
    out = np.zeros(int(ends[-1]), np.uint8)
    _put(out, begins, per_term, 4)
    _move(out, heads.reshape(-1).view(np.uint8), heads_ends, begins + 4)
    _move(out, front.reshape(-1).view(np.uint8), fronts_ends, begins + 4 + per_term * 16)
    _move(out, data, datas_ends, ends - np.diff(datas_ends, prepend=0))
    offsets = pa.py_buffer(np.append(0, ends).astype("<i4"))
    lists = pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(out)])
    return term[head], df, lists


def _segment(seg: int, ids: list, lengths: list[int], chunks: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    """Index rows of one segment; that without a term lists the documents and their lengths, in order of id."""
    keys = pa.array(ids, pa.int64())
    order = pc.sort_indices(keys, null_placement="at_end").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    length = np.array(lengths, np.int64)
    ordered = length[order]
    one = pa.array([seg], pa.int64())
    yield pa.RecordBatch.from_arrays(
        [
            one,
            pa.array([None], pa.binary()),
            pa.array([int((length > 0).sum())], pa.int64()),
            pa.array([int(length.sum())], pa.int64()),
            pa.array([ordered.astype("<u4").tobytes()], pa.binary()),
            pa.array([keys.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())),
        ],
        names=["seg", "term", "df", "n_words", "list", "ids"],
    )
    if not chunks:
        return
    coded = pa.concat_arrays(chunks).dictionary_encode()
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(order) + np.repeat(rank, length)
    pair, tf = np.unique(key, return_counts=True)
    term, df, lists = _posting_lists(pair // len(order), pair % len(order), tf, ordered)
    rows = pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(term), seg)),
            coded.dictionary.take(pa.array(term)),
            pa.array(df),
            pa.nulls(len(term), pa.int64()),
            lists,
            pa.nulls(len(term), pa.list_(pa.int64())),
        ],
        names=["seg", "term", "df", "n_words", "list", "ids"],
    )
    for at in range(0, len(term), 1 << 15):
        yield rows.slice(at, 1 << 15)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Written index of all rows of ``docs``; ``key`` is a BIGINT. A repeated task writes the same segments."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 32
        ids, lengths, chunks, held, total = [], [], [], [], 0
        for batch in batches:
            for id_, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                found = terms(t.as_py())
                ids.append(id_)
                lengths.append(len(found))
                held += found
                total += len(found)
                if len(held) >= 1 << 16:
                    chunks.append(pa.array(held, pa.binary()))
                    held = []
                if total + len(ids) >= segment:
                    chunks += [pa.array(held, pa.binary())] if held else []
                    yield from _segment(seg, ids, lengths, chunks)
                    seg, ids, lengths, chunks, held, total = seg + 1, [], [], [], [], 0
        if ids:
            chunks += [pa.array(held, pa.binary())] if held else []
            yield from _segment(seg, ids, lengths, chunks)

    rows = docs.select(F.col(key).cast("bigint"), F.col(text).cast("string"))
    return materialize(rows.mapInArrow(run, _INDEX), "postings")


# ---- search --------------------------------------------------------------------------------------


class PostingList:
    """One term's list in a segment: bounds from the heads, blocks decompressed when asked for."""

    def __init__(self, data: bytes, weight: int, norm: np.ndarray, norm_of) -> None:
        n = int.from_bytes(data[:4], "little")
        heads = np.frombuffer(data, "<u4", 4 * n, 4).reshape(n, 4).astype(np.int64)
        self.last, self.at, ends, self.meta = heads.T
        front = np.frombuffer(data, "<u4", 2 * int(ends[-1]), 4 + 16 * n).reshape(-1, 2).astype(np.int64)
        best = impact(weight, front[:, 0], norm_of(front[:, 1]))
        self.block_max = np.maximum.reduceat(best, np.append(0, ends[:-1]))
        self.bound = int(self.block_max.max())
        self.data, self.start = data, 4 + 16 * n + 8 * int(ends[-1])
        self.weight, self.norm = weight, norm
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.whole: tuple[np.ndarray, np.ndarray] | None = None

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and what the term adds to their scores."""
        if b not in self.blocks:
            n, at = int(self.meta[b]) & 0xFF, self.start + int(self.at[b])
            doc_width, tf_width = (int(_WIDTHS[int(self.meta[b]) >> s & 3]) for s in (8, 10))
            docs = self._numbers(at, n, doc_width)
            docs[0] += self.last[b - 1] if b else 0
            docs = np.cumsum(docs)
            tf = self._numbers(at + n * doc_width, n, tf_width) + 1
            self.blocks[b] = docs, impact(self.weight, tf, self.norm[docs])
        return self.blocks[b]

    def _numbers(self, at: int, n: int, width: int) -> np.ndarray:
        return np.frombuffer(self.data, f"<u{width}", n, at).astype(np.int64) if width else np.zeros(n, np.int64)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.whole is None:
            parts = [self.block(b) for b in range(len(self.last))]
            self.whole = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return self.whole


def impact(weight: int, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Part of a score: grows with the count ``tf``, falls with ``norm``."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm))


class Heap:
    """The best documents of one item: by score, then by id with a null id last."""

    def __init__(self, k: int) -> None:
        self.k, self.scores = k, np.empty(0, np.int64)
        self.ids, self.null = np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """A document below this score has no place; 1 while there is room."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


def max_score(lists: list[tuple[PostingList, int]], heap: Heap, lo: int, hi: int, ids: np.ndarray, null: np.ndarray) -> None:
    """Add the documents ``lo..hi`` of a segment to ``heap``; ``lists`` are ordered by bound times repeats."""
    total = np.cumsum([p.bound * times for p, times in lists])
    least = heap.least
    essential = int(np.searchsorted(total, least))  # lists before it cannot reach the threshold together
    score = np.zeros(hi - lo, np.int64)
    for p, times in lists[essential:]:
        docs, part = p.all()
        a, b = np.searchsorted(docs, (lo, hi))
        score[docs[a:b] - lo] += part[a:b] * times
    found = np.flatnonzero(score)
    for j in range(essential - 1, -1, -1):
        p, times = lists[j]
        below = int(total[j - 1]) if j else 0
        found = found[score[found] + int(total[j]) >= least]
        block = np.searchsorted(p.last, found + lo)
        there = block < len(p.last)
        most = np.where(there, p.block_max[np.minimum(block, len(p.last) - 1)], 0) * times
        fine = score[found] + most + below >= least
        found, block = found[fine], np.where(there, block, -1)[fine]
        for b in np.unique(block[block >= 0]):
            docs, part = p.block(int(b))
            own = found[block == b]
            at = np.minimum(np.searchsorted(docs, own + lo), len(docs) - 1)
            hit = docs[at] == own + lo
            score[own[hit]] += part[at[hit]] * times
    found = found[score[found] >= least]
    if len(found):
        heap.add(score[found], ids[found + lo], null[found + lo])


def _score_segment(table: pa.Table, heaps: dict[int, Heap], n_docs: int, n_words: int, k: int) -> None:
    """Score one batch of items in one segment; the first row lists the documents."""
    head = table.slice(0, 1)
    length = np.frombuffer(head.column("list")[0].as_py(), "<u4").astype(np.int64)
    keys = head.column("ids").combine_chunks().values
    ids, null = keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False)

    def norm_of(n: np.ndarray) -> np.ndarray:
        return 100 - 75 + (75 * n * n_docs) // n_words

    norm, per_item = norm_of(length), {}
    rows = table.slice(1)
    for data, weight, asks in zip(*(rows.column(c) for c in ("list", "w", "asks"))):
        p = PostingList(data.as_py(), weight.as_py(), norm, norm_of)
        if p.bound:
            for ask in asks.as_py():
                per_item.setdefault(ask["no"], []).append((p, ask["times"]))
    for no, lists in per_item.items():
        lists.sort(key=lambda x: x[0].bound * x[1])
        heap = heaps.setdefault(no, Heap(k))
        start = FIRST_WINDOW if len(heap.scores) < k else 0
        edges = [0, min(start, len(length)), len(length)]
        for lo, hi in zip(edges, edges[1:]):
            if lo < hi:
                max_score(lists, heap, lo, hi, ids, null)


def search(
    index: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", k: int = TOP, batch: int = ITEMS
) -> DataFrame:
    """``key, rank, doc_id, score``: the ``k`` documents with the highest positive scores for each row of ``items``."""
    spark = items.sparkSession
    ship_package(spark)
    n_docs, n_words = index.filter("term is null").agg(F.sum("df"), F.sum("n_words")).first()
    items = items.select(F.col(key), F.col(text).cast("string").alias("__text"))
    items = materialize(items.withColumn("__no", F.monotonically_increasing_id()), "items")
    batches = -(-items.count() // batch)

    def split(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            no, found = [], []
            for n, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())):
                own = terms(t.as_py())
                no += [n] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(found, pa.binary())], names=["no", "term"])

    asked = items.select("__no", "__text").mapInArrow(split, "no bigint, term binary").groupBy("no", "term")
    group = F.pmod(F.xxhash64("no"), F.lit(max(batches, 1))).cast("bigint").alias("batch")
    asked = materialize(asked.agg(F.count("*").alias("times")).select("*", group), "asked")

    # the lists of asked terms, written so that the index is read once; their counts give the weights
    lists = index.filter("term is not null").join(asked.select("term").distinct(), "term", "left_semi")
    lists = materialize(lists.select("seg", "term", "df", "list"), "lists")
    weight = F.floor(1000 * F.ln(F.lit(2.0 * (n_docs or 0) + 2) / (2 * F.sum("df") + 1)))
    weights = lists.groupBy("term").agg(weight.alias("w"))
    asks = F.collect_list(F.struct("no", "times")).alias("asks")
    weights = asked.groupBy("batch", "term").agg(asks).join(weights, "term")
    met = lists.join(weights, "term").select("seg", "batch", "term", "w", "asks", "list", F.lit(None).cast("array<bigint>").alias("ids"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(batches, 1) - 1).cast("bigint"))).alias("batch")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("w", "bigint"), ("asks", "array<struct<no:bigint,times:bigint>>"))]
    heads = index.filter("term is null").select("seg", every, "term", *none, "list", "ids")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, heaps = None, {}
        for table in whole_groups(rows, ["batch", "seg"]):
            starts = group_heads(table, ["batch", "seg"]).tolist()
            for at, end in zip(starts, [*starts[1:], table.num_rows]):
                group = table.slice(at, end - at)
                if group.column("batch")[0].as_py() != current:
                    yield _best(heaps)
                    current, heaps = group.column("batch")[0].as_py(), {}
                if group.num_rows > 1:
                    _score_segment(group, heaps, n_docs, n_words, k)
        yield _best(heaps)

    rows = met.unionAll(heads).repartition("seg").sortWithinPartitions("batch", "seg", F.asc_nulls_first("term"))
    best = rows.mapInArrow(run, "no bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = items.select(F.col("__no").alias("no"), F.col(key).alias("__key"))
    return ranked.join(named, "no").select(F.col("__key").alias(key), "rank", "doc_id", "score")


def _best(heaps: dict[int, Heap]) -> pa.RecordBatch:
    no = np.repeat(np.array(list(heaps), np.int64), [len(h.scores) for h in heaps.values()])
    ids = np.concatenate([h.ids for h in heaps.values()] or [np.empty(0, np.int64)])
    null = np.concatenate([h.null for h in heaps.values()] or [np.empty(0, bool)])
    scores = np.concatenate([h.scores for h in heaps.values()] or [np.empty(0, np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(no), pa.array(ids, mask=null), pa.array(scores)], names=["no", "doc_id", "score"])
