"""Language-model scoring by cross-entropy difference.

Two interpolated bigram models are compared: a target model of trusted documents and a background model of
all documents. They are matched: one vocabulary, one inventory of bigrams, one smoothing:

    p(w)     = (c(w) + 1) / (N + V)
    p(w | h) = (c(h w) + (t(h) + r(h)) p(w)) / (c(h) + t(h))

``c(h)`` counts all bigrams that begin with ``h``, ``t(h)`` the inventory bigrams among them that occur, and
``r(h)`` the occurrences outside the inventory, so probabilities sum to one in either model. The score of a
document is the mean over its words of ``loss_target - loss_background``: the lower, the closer to the target.

Vocabulary and inventory are all words and bigrams of the documents and the target, and ``<unk>`` (see
``lm_tables``). A caller can ask for a model of a given size instead: then the vocabulary holds the most frequent words of
the target, every other word is ``<unk>``, and the inventory its most frequent bigrams. The counts are never sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .lm_tables import losses_by_tables


class Inventory:
    """Numbers of words and bigrams. Word 0 is ``<unk>``; a bigram's key is ``first * size + second``."""

    def __init__(self, words: list[bytes], keys: np.ndarray):
        self.number = {w: i for i, w in enumerate(words, 1)}
        self.size = len(words) + 1
        self.keys = np.sort(keys)

    def encode(self, text: bytes | None) -> np.ndarray:
        found = (text or b"").lower().split()
        return np.fromiter(map(self.number.get, found, repeat(0)), np.int64, len(found))

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each bigram in the inventory, and whether it is there."""
        keys = ids[:-1] * self.size + ids[1:]
        if not len(self.keys) or not len(keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def count(self, texts: Iterator[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of words, of words as first of a bigram, and of inventory bigrams."""
        uni, first, bi = (np.zeros(n, np.int64) for n in (self.size, self.size, len(self.keys)))
        held: list[np.ndarray] = []

        def flush():
            for ids in held:
                at, ok = self.places(ids)
                np.add.at(bi, at[ok], 1)
            both = np.concatenate(held)
            uni[:] += np.bincount(both, minlength=self.size)
            first[:] += np.bincount(np.concatenate([ids[:-1] for ids in held]), minlength=self.size)
            held.clear()

        n = 0
        for text in texts:
            ids = self.encode(text)
            held.append(ids)
            n += len(ids)
            if n >= 1 << 20:
                flush()
                n = 0
        if held:
            flush()
        return uni, first, bi


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes | None]:
    for batch in batches:
        for text in batch.column("__text").cast(pa.large_binary()):
            yield text.as_py()


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, counts in enumerate(shared.value.count(_texts(batches))):
            at = np.flatnonzero(counts)
            columns = [pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(counts[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "at", "n"])

    return run


def _counts(docs: DataFrame, text: str, inventory: Inventory, shared) -> list[np.ndarray]:
    rows = docs.select(F.col(text).alias("__text")).mapInArrow(_counter(shared), "kind int, at bigint, n bigint")
    table = rows.groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
    kind, at, n = (table.column(c).to_numpy() for c in ("kind", "at", "n"))
    out = [np.zeros(k, np.int64) for k in (inventory.size, inventory.size, len(inventory.keys))]
    for k, counts in enumerate(out):
        counts[at[kind == k]] = n[kind == k]
    return out


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fit_inventory(target: DataFrame, text: str, vocabulary: int, inventory: int) -> Inventory:
    """Most frequent words and bigrams of the target, ties in order of the words."""
    from .words import words

    listed = target.select(words(_lower(F.col(text))).alias("w"))
    counted = listed.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(vocabulary).select("word").collect()
    model = Inventory([r.word.encode() for r in top], np.empty(0, np.int64))
    ship_package(target.sparkSession)
    shared = target.sparkSession.sparkContext.broadcast(model)

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_ = shared.value
        for batch in batches:
            keys = [np.empty(0, np.int64)]
            for text_ in _texts(iter([batch])):
                ids = words_.encode(text_)
                keys.append(ids[:-1] * words_.size + ids[1:])
            found, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["key", "n"])

    pairs = target.select(F.col(text).alias("__text")).mapInArrow(bigrams, "key bigint, n bigint")
    pairs = pairs.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(inventory)
    model.keys = np.sort(pairs.select("key").toArrow().column("key").to_numpy())
    shared.unpersist()
    return model


class Model:
    """Losses of words, of inventory bigrams, and of backing off from each first word."""

    def __init__(self, inventory: Inventory, uni: np.ndarray, first: np.ndarray, bi: np.ndarray):
        p = (uni + 1) / (uni.sum() + inventory.size)
        head, tail = inventory.keys // inventory.size, inventory.keys % inventory.size
        inside = np.bincount(head, weights=bi, minlength=inventory.size)
        kinds = np.bincount(head[bi > 0], minlength=inventory.size)
        total = first + kinds
        off = np.where(total > 0, kinds + first - inside, 1.0)
        total = np.where(total > 0, total, 1.0)
        # a word that only inventory bigrams follow still has its kinds as mass for others
        self.word = -np.log(p)
        self.back = -np.log(off / total)
        self.pair = -np.log((bi + off[head] * p[tail]) / total[head])

    def losses(self, inventory: Inventory, ids: np.ndarray, at: np.ndarray, ok: np.ndarray) -> float:
        if not len(ids):
            return 0.0
        rest = ~ok
        return float(
            self.word[ids[0]]
            + self.pair[at[ok]].sum()
            + self.back[ids[:-1][rest]].sum()
            + self.word[ids[1:][rest]].sum()
        )


def _scorer(keys: list[str], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inventory, target, background = shared.value
        for batch in batches:
            rows = np.zeros((batch.num_rows, 3))
            for i, text in enumerate(_texts(iter([batch]))):
                ids = inventory.encode(text)
                at, ok = inventory.places(ids)
                n = max(len(ids), 1)
                rows[i] = len(ids), *(m.losses(inventory, ids, at, ok) / n for m in (target, background))
            columns = [batch.column(k) for k in keys]
            columns += [pa.array(rows[:, 0].astype(np.int64)), pa.array(rows[:, 1]), pa.array(rows[:, 2])]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "n_tokens", "target_loss", "background_loss"])

    return run


def cross_entropy_difference(
    docs: DataFrame,
    target: DataFrame,
    keys: list[str],
    text: str = "text",
    vocabulary: int | None = None,
    inventory: int | None = None,
) -> DataFrame:
    """``keys, n_tokens, target_loss, background_loss, score`` for every row of ``docs``.

    ``target`` holds the trusted documents. NULL and empty texts have no tokens and all values 0. With an
    empty target all scores are 0. Rows that repeat are scored and counted as often as they come. Without
    ``vocabulary`` and ``inventory`` the models hold every word and bigram.
    """
    spark = docs.sparkSession
    if vocabulary is None and inventory is None:
        out = losses_by_tables(docs, target, keys, text)
        return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
    if vocabulary is None or inventory is None:
        raise ValueError("a model of a given size needs vocabulary and inventory")
    model = fit_inventory(target, text, vocabulary, inventory)
    shared = spark.sparkContext.broadcast(model)
    near, far = (Model(model, *_counts(rows, text, model, shared)) for rows in (target, docs))
    both = spark.sparkContext.broadcast((model, near, far))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    out = docs.select(*keys, F.col(text).alias("__text")).mapInArrow(
        _scorer(keys, both), f"{kinds}, n_tokens bigint, target_loss double, background_loss double"
    )
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def score_by_labels(docs: DataFrame, labels: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``cross_entropy_difference`` against the trusted documents; the first key is the ``doc_id`` of the labels."""
    out = losses_by_tables(docs, None, keys, text, trusted_labels(labels))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def trusted_labels(labels: DataFrame) -> DataFrame:
    """Ids of the documents that every label calls good and not toxic."""
    good = labels.filter("doc_id is not null").groupBy("doc_id")
    return good.agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and t = 0").select("doc_id")


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents that every label calls good and not toxic, written once, since the model reads them thrice."""
    good = trusted_labels(labels)
    # labels grow with the corpus, so this is a shuffle join at every size
    return materialize(docs.join(good.hint("merge"), "doc_id", "left_semi"), "target")
