"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The base finds e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers by pattern. The method
adds what a conditional random field tags beyond them. Its tokens are the words that hold a digit or ``@``; every
other word is outside by construction, so a text falls into short runs of such words, and Viterbi decoding
of the runs is exact for the whole text. Features are shapes: of the word, of its neighbours, and of the
word with digit counts. The field is trained on a small labelled table (``label_runs``: runs of a bounded sample
of documents, labelled by the base) and decoded in numpy over all runs of a batch at once.

A tagged stretch becomes a span if it touches no base span and every word in it has a posterior of at least
``CONFIDENCE``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS)
#: documents of the labelled table, runs taken from them, and words of a run used in training, at most
TRAIN_DOCS, TRAIN_RUNS, TRAIN_LENGTH = 20_000, 20_000, 40
CONFIDENCE = 0.95
STEPS, RATE, DECAY = 150, 0.3, 1e-3

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = " \t\n\x0b\x0c\r"
_SPACES = re.compile(r"[\x20\x09-\x0D]")

Span = tuple[str, int, int]


# ---- base ----


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outwards: long words without one cost nothing."""
    end, before = 0, 0
    at = text.find("@")
    while at >= 0:
        low = max(end, before)
        name = len(text[low:at]) - len(text[low:at].rstrip(_LOCAL))
        match = _DOMAIN.match(text, at + 1) if name else None
        if match:
            yield at - name, match.end()
            end = match.end()
        before = at + 1
        at = text.find("@", max(before, end))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time from each dotted run of numbers."""
    for run in _DOTTED.finditer(text):
        at, parts = run.start(), run.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str | None) -> list[Span]:
    """``kind, start, end`` in code points, by kind as listed and then start."""
    if not text or not _MARK.search(text):
        return []
    spans = [("email", a, b) for a, b in _emails(text)] + [("ip", a, b) for a, b in _addresses(text)]
    for kind, pattern, low, high in (("card", _CARD, 13, 19), ("phone", _PHONE, 9, 15)):
        for match in pattern.finditer(text):
            if match.end() - match.start() > 4 * high + 64 and kind == "card":
                continue  # at most one separator to a digit: far too many digits
            digits = re.sub("[^0-9]", "", match.group())
            if low <= len(digits) <= high and (kind == "phone" or _luhn(digits)):
                spans.append((kind, match.start(), match.end()))
    return spans


# ---- runs of words ----


@dataclass
class Run:
    """Neighbouring words with a digit or ``@``, and the words beside the run."""

    spans: list[tuple[int, int]]
    before: str
    after: str


def _next_space(text: str, at: int) -> int:
    match = _SPACES.search(text, at)
    return match.start() if match else len(text)


def find_runs(text: str) -> list[Run]:
    """Runs in order. A run ends at a line break or at a word without a mark."""
    spans, end = [], 0
    match = _MARK.search(text)
    while match:
        at = match.start()
        start = max(end, *(text.rfind(c, end, at) + 1 for c in _SPACE))
        end_of = _next_space(text, at)
        spans.append((start, end_of))
        end = end_of
        match = _MARK.search(text, end)
    runs: list[Run] = []
    for i, (start, end) in enumerate(spans):
        gap = text[spans[i - 1][1] : start] if i else "x"
        if i and "\n" not in gap and not gap.strip(_SPACE):
            runs[-1].spans.append((start, end))
        else:
            runs.append(Run([(start, end)], "", ""))
    for run in runs:
        first, last = run.spans[0][0], run.spans[-1][1]
        left, right = text[max(first - 32, 0) : first].split(), text[last : last + 32].split()
        run.before, run.after = left[-1] if left else "", right[0] if right else ""
    return runs


_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"[0-9]+")


def _shape(word: str, count: bool = False) -> str:
    """Letters become ``x``, digits ``d``; with ``count`` each group of digits keeps its length."""
    word = word[:64]
    parts, at = [], 0
    for match in _DIGITS.finditer(word):
        parts += [_LETTERS.sub("x", word[at : match.start()]), f"d{match.end() - match.start()}" if count else "d"]
        at = match.end()
    return "".join(parts) + _LETTERS.sub("x", word[at:])


def run_features(text: str, run: Run) -> list[tuple[str, ...]]:
    """Features of each word of a run."""
    found = [text[a:b] for a, b in run.spans]
    shapes = [_shape(run.before), *map(_shape, found), _shape(run.after)]
    return [
        ("w:" + shapes[i], "n:" + _shape(word, True), "l:" + shapes[i - 1], "r:" + shapes[i + 1])
        for i, word in enumerate(found, 1)
    ]


# ---- the field ----


class Chain:
    """Weights of a linear-chain conditional random field; all runs of a batch are computed at once."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves

    def emissions(self, words: list[tuple[str, ...]]) -> np.ndarray:
        ids = np.array([[self.names.get(f, 0) for f in w] for w in words], np.int64).reshape(len(words), -1)
        return self.weights[ids].sum(axis=1)


def _active(lengths: np.ndarray) -> list[int]:
    """Runs in order of falling length: how many still have a word at each step."""
    return [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths.max(initial=0)))]


def viterbi(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of all words; runs lie one after the other in ``emissions``."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    active = _active(lengths[order])
    out = np.zeros(len(emissions), np.int64)
    if not active:
        return out
    score, back = emissions[starts].copy(), []
    for t, n in enumerate(active[1:], 1):
        paths = score[:n, :, None] + moves
        back.append(paths.argmax(axis=1))
        score[:n] = paths.max(axis=1) + emissions[starts[:n] + t]
    label = score.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        out[starts[:n] + t] = label[:n]
        if t:
            label[:n] = back[t - 1][np.arange(n), label[:n]]
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each label at each word, and expected number of each move."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    active = _active(lengths[order])
    k = emissions.shape[1]
    forward, backward, expected = np.zeros_like(emissions), np.zeros_like(emissions), np.zeros((k, k))
    if not active:
        return forward, expected
    forward[starts] = emissions[starts]
    for t, n in enumerate(active[1:], 1):
        at = starts[:n] + t
        forward[at] = _logsum(forward[at - 1][:, :, None] + moves, 1) + emissions[at]
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        ahead = moves + (emissions[at] + backward[at])[:, None, :]
        backward[at - 1] = _logsum(ahead, 2)
        joint = forward[at - 1][:, :, None] + ahead
        joint -= _logsum(joint.reshape(len(at), -1), 1)[:, None, None]
        expected += np.exp(joint).sum(axis=0)
    both = forward + backward
    return np.exp(both - _logsum(both, 1)[:, None]), expected


def train(table: list[tuple[list[tuple[str, ...]], list[int]]]) -> Chain:
    """Fit the field to ``(features, labels)`` per run by gradient steps with weight decay.

    Rows are used in the order given and weights start at zero, so equal tables give equal fields. An empty
    table gives a field that tags nothing.
    """
    names: dict[str, int] = {}
    for features, _ in table:
        for word in features:
            for f in word:
                names.setdefault(f, len(names) + 1)
    k = len(LABELS)
    weights, moves = np.zeros((len(names) + 1, k)), np.zeros((k, k))
    if not table:
        weights[0, 0] = 10.0
        return Chain(names, weights, moves)
    ids = np.array([[names[f] for f in w] for features, _ in table for w in features], np.int64)
    gold = np.array([y for _, labels in table for y in labels], np.int64)
    lengths = np.array([len(labels) for _, labels in table], np.int64)
    inner = np.ones(len(gold), bool)
    inner[np.cumsum(lengths) - lengths] = False
    inner = np.flatnonzero(inner)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
    sums = [np.zeros_like(weights) + 1e-8, np.zeros_like(moves) + 1e-8]
    for _ in range(STEPS):
        posterior, expected = marginals(weights[ids].sum(axis=1), lengths, moves)
        posterior[np.arange(len(gold)), gold] -= 1
        slope = np.zeros_like(weights)
        for column in ids.T:
            np.add.at(slope, column, posterior)
        for value, gradient, total in ((weights, slope, sums[0]), (moves, expected - seen, sums[1])):
            gradient = gradient / len(table) + DECAY * value
            total += gradient**2
            value -= RATE * gradient / np.sqrt(total)
    weights[0] = 0
    weights[0, 0] = 1.0  # a feature that was never seen speaks for outside
    return Chain(names, weights, moves)


# ---- Spark ----

_TRIM = "\"'.,;:!?<>[]{}|*#$%&=~`"


def _labels(run: Run, spans: list[Span]) -> list[int]:
    out = []
    for a, b in run.spans:
        out.append(next((LABELS.index(k) for k, s, e in spans if s < b and e > a), 0))
    return out


class _ByPlace:
    """Base spans, of which those of one kind do not overlap, found by place in logarithmic time."""

    def __init__(self, spans: list[Span]) -> None:
        self.kinds: list[tuple[list[Span], list[int], list[int]]] = []
        for kind in KINDS:
            own = [s for s in spans if s[0] == kind]
            self.kinds.append((own, [s[1] for s in own], [s[2] for s in own]))

    def within(self, start: int, end: int) -> list[Span]:
        """Spans that share a place with ``start..end``, in order of kind and place."""
        out: list[Span] = []
        for own, starts, ends in self.kinds:
            out += own[bisect_right(ends, start) : bisect_left(starts, end)]
        return out


def label_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Labelled table: ``features, labels`` of every run of at most ``TRAIN_LENGTH`` words in ``docs``."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, labels = [], []
            for value in batch.column("__text"):
                text_ = value.as_py()
                if not text_ or not _MARK.search(text_):
                    continue
                spans = _ByPlace(base_spans(text_))
                for found in find_runs(text_):
                    if len(found.spans) > TRAIN_LENGTH:
                        continue
                    near = spans.within(found.spans[0][0], found.spans[-1][1])
                    features.append([list(f) for f in run_features(text_, found)])
                    labels.append(_labels(found, near))
            columns = [pa.array(features, pa.list_(pa.list_(pa.string()))), pa.array(labels, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["features", "labels"])

    rows = docs.select(F.col(text).alias("__text"))
    return rows.mapInArrow(run, "features array<array<string>>, labels array<int>")


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", rows: int = TRAIN_DOCS, runs: int = TRAIN_RUNS) -> Chain:
    """Train on the runs of the ``rows`` documents whose ids have the smallest hashes, at most ``runs`` of them."""
    ids = docs.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(rows)
    table = label_runs(docs.join(F.broadcast(ids), key, "left_semi"), text)
    order = F.xxhash64("features", "labels")
    found = table.orderBy(order, "features", "labels").limit(runs).toArrow().to_pylist()
    return train([([tuple(f) for f in r["features"]], r["labels"]) for r in found])


def _added(texts: list[tuple[int, str, list[Span]]], chain: Chain) -> dict[int, list[Span]]:
    """Spans the field adds, per text number; all runs are decoded together."""
    runs = [(i, text, run) for i, text, _ in texts for run in find_runs(text)]
    if not runs:
        return {}
    lengths = np.array([len(run.spans) for *_, run in runs], np.int64)
    emissions = chain.emissions([f for _, text, run in runs for f in run_features(text, run)])
    labels = viterbi(emissions, lengths, chain.moves)
    ends = np.cumsum(lengths)
    out: dict[int, list[Span]] = {}
    placed = {i: _ByPlace(spans) for i, _, spans in texts}
    for (i, text, run), end, n in zip(runs, ends, lengths):
        tags = labels[end - n : end]
        if not tags.any():
            continue
        free = np.array([not placed[i].within(a, b) for a, b in run.spans])
        if not (free & (tags > 0)).any():
            continue
        sure = marginals(emissions[end - n : end], np.array([n]), chain.moves)[0][np.arange(n), tags] >= CONFIDENCE
        at = 0
        while at < n:
            stop = at + 1
            while stop < n and tags[stop] == tags[at]:
                stop += 1
            if tags[at] and free[at:stop].all() and sure[at:stop].all():
                a, b = run.spans[at][0], run.spans[stop - 1][1]
                word = text[a:b]
                a, b = a + len(word) - len(word.lstrip(_TRIM)), b - (len(word) - len(word.rstrip(_TRIM)))
                if a < b:
                    out.setdefault(i, []).append((LABELS[tags[at]], a, b))
            at = stop
    return out


def _order(span: Span) -> tuple[int, int, int]:
    return KINDS.index(span[0]), span[1], span[2]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _tagger(keys: list[str], shared):
    def listed(spans: list[Span]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k, a, b in sorted(spans, key=_order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            base, marked = [], []
            for i, value in enumerate(batch.column("__text")):
                text = value.as_py()
                base.append(base_spans(text))
                if text and _MARK.search(text):
                    marked.append((i, text, base[-1]))
            more = _added(marked, chain)
            whole = [listed([*spans, *more.get(i, [])]) for i, spans in enumerate(base)]
            columns = [batch.column(k) for k in keys]
            columns += [pa.array([listed(s) for s in base], _SPAN), pa.array(whole, _SPAN)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "base", "spans"])

    return run


def find_personal_data(docs: DataFrame, chain: Chain, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, base, spans`` for every row: arrays of ``kind, start, end``, in code points, end exclusive.

    NULL and empty texts have no spans. Repeated rows are tagged alike. ``spans`` holds all of ``base``.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    rows = docs.select(*keys, F.col(text).alias("__text"))
    return rows.mapInArrow(_tagger(keys, spark.sparkContext.broadcast(chain)), f"{kinds}, base {span}, spans {span}")
