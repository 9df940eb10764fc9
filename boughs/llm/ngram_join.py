"""Jaccard self-join of word n-gram sets through token-combination prefixes.

A document's tokens are its distinct word shingles as 64-bit hashes. Two sets link if they share at least ``percent`` of
their union. A set of ``n`` tokens can then miss at most ``n - ceil(percent * n)`` tokens of a partner.

Prefixes. Tokens are ordered: rare ones first, frequent ones after them by frequency. Tokens found in more than ``RARE``
documents are frequent; they form classes, and class ``k`` is indexed by combinations of ``k`` tokens (two, or three for
the most frequent), rare ones by single tokens. Combinations are taken inside small groups of a class, so their number
grows with the prefix and not with its square. The prefix is extended until its rare tokens, plus each group's tokens
beyond its first ``k - 1``, outnumber the tokens a set may miss: however the missing ones are spread, two linked sets then
share one single token or one whole combination, and meet in its bucket.

Only tokens in the lower part of the hash range are counted; a prefix seldom needs more, and where it does, the rest is
used as the last class. Sets meet within octaves of their size; a set that may link to a smaller octave is indexed
there too. So the number of index rows is a fixed share of the tokens, and every link is found for any data.

Verification. In each bucket one set is the hub, and all others are checked against it, so a group of near copies costs
one check each; where components still meet, once more against a set drawn for the bucket. Buckets whose sets are then in
different components compare those that are, pruned by size and by a
parity bitmap whose differing bits never outnumber the differing tokens; a pair known to share an earlier bucket is left
to that one. Surviving pairs are verified on the full sets.
Equal sets are one class from the start. No bucket is expanded into pairs, and buckets above ``BLOCK`` are cut into blocks.

Defined results: null, empty and blank texts have an empty set and link with nothing, so each is its own component;
repeated rows are listed as often as they come; rows with a null id take part, and a component of only such rows has a
null id; an empty table gives no rows; texts of any length are used whole. Hash collisions of 64 bits inside a pair are not
resolved (below 1e-9 for sets of 100,000); set fingerprints are, by a second hash. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grouped import group_heads, whole_groups
from ..session import materialize, ship_package
from .components import components

GRAM, PERCENT = 4, 85
#: documents up to which a token is rare, and up to which pairs of frequent ones are enough (a multiple of it)
RARE, TRIPLES = 64, 64
#: frequent tokens sent to tasks; with more, fewer are frequent
FREQUENT = 1 << 18
#: tokens of a prefix in one group of a class
GROUP = 8
#: sets of a bucket that one task compares with as many others; sets fetched by a broadcast of their ids
BLOCK, WANTED = 2048, 1 << 20
#: buckets of a set that others are told of, so that a pair with many common buckets is compared in one
FIRST = 16
#: texts cut into words at once, in bytes; also tokens of the sets held at once
CHUNK = 1 << 18

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))

_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


@cache
def _powers(size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For two hashes: a number for each byte, the powers of the base, and those of its inverse."""
    numbers = np.random.default_rng(1).integers(0, 1 << 64, (2, 256), np.uint64)
    out = []
    for row, base in zip(numbers, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        up, down = (np.cumprod(np.full(size, b, np.uint64)) for b in (base, pow(base, -1, 1 << 64)))
        out.append((row, up, down))
    return out


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in ``data``, which ends with a blank, and a 64-bit hash of each: two polynomials over its bytes."""
    raw = np.frombuffer(data, np.uint8)
    blank = raw == 32
    edge = np.flatnonzero(blank != np.append(True, blank[:-1]))
    start, end = edge[::2], edge[1::2]
    h = (end - start).astype(np.uint64)
    for row, up, down in _powers(max(CHUNK, 1 << (len(data) - 1).bit_length())):
        total = np.append(np.uint64(0), np.cumsum(row[raw] * up[: len(raw)]))
        h = _mixed(h + (total[end] - total[start]) * down[start])
    return start, h


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def token_sets(texts: pa.Array, gram: int = GRAM) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each UTF-8 text; fewer words than ``gram`` are one shingle."""
    for start, h, ends in _words_of(texts):
        first = np.searchsorted(start, np.append(0, ends))
        for at, to in zip(first, first[1:]):
            own, n = h[at:to], int(to - at)
            width = min(n, gram)
            total = np.full(n - width + 1 if n else 0, width, np.uint64)
            for i in range(width):
                total = total * _MIX[2] + own[i : n - width + 1 + i]
            yield _distinct(_mixed(total))


def _words_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word starts and hashes of some texts in a row, and where each of these texts ends."""

    def hashed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, found, at = b" ".join([*parts, b""]).translate(_FOLD), [], 0
        while at < len(data):  # a long text goes through in pieces that end with a blank
            to = len(data) if len(data) - at <= CHUNK else data.find(b" ", at + CHUNK - 1) + 1
            start, h = _word_hashes(data[at:to])
            found.append((start + at, h))
            at = to
        starts, hashes = (np.concatenate(x) for x in zip(*found))
        return starts, hashes, np.cumsum([len(p) + 1 for p in parts])

    held, size = [], 0
    for text in texts:
        held.append(text.as_py() or b"")
        size += len(held[-1]) + 1
        if size >= CHUNK:
            yield hashed(held)
            held, size = [], 0
    if held:
        yield hashed(held)


def _class_of(tokens: np.ndarray, seed: int) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes(), seed) - (1 << 63)


def _octave(n: int) -> int:
    return n.bit_length() - 1


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity bitmap of 2**octave bits: bit ``j`` tells whether an odd number of tokens falls on it."""
    bits = max(64, 1 << _octave(len(tokens)))
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same tokens with fewer bits."""
    while len(bitmap) > words:
        bitmap = bitmap[: len(bitmap) // 2] ^ bitmap[len(bitmap) // 2 :]
    return bitmap


def _least_overlap(n, m, percent: int):
    """Smallest intersection of sets of ``n`` and ``m`` tokens that link."""
    return -(-percent * (n + m) // (100 + percent))


def _may_link(n, m, differing, percent: int):
    close = (percent * n <= 100 * m) & (percent * m <= 100 * n)
    return close & (differing <= n + m - 2 * _least_overlap(n, m, percent))


def _part(octave: int) -> float:
    """Part of the hash range whose tokens are counted: wide enough for a prefix of sets in this octave."""
    return 1.0 if octave < 6 else 0.35 if octave < 9 else 0.25


def _octaves(n: int, percent: int) -> list[int]:
    """Octaves in which a set of ``n`` tokens can meet partners no larger than the octave."""
    own = _octave(n)
    return [own, own - 1] if own and percent * n <= 100 * ((1 << own) - 1) else [own]


def _zone(tokens: np.ndarray, octave: int) -> int:
    part = _part(octave)
    return len(tokens) if part == 1.0 else int(np.searchsorted(tokens, np.uint64(int(part * (1 << 64)))))


class Prefixes:
    """Index keys of a set, given the frequent tokens (sorted) and their class."""

    def __init__(self, frequent: np.ndarray, k: np.ndarray, percent: int = PERCENT) -> None:
        self.frequent, self.k, self.percent = frequent, k, percent

    def keys(self, tokens: np.ndarray, octave: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Keys of single tokens, keys of combinations, and the share of rare tokens among those counted."""
        n = len(tokens)
        need = n - -(-self.percent * n // 100) + 1
        salt = _mixed(np.array([octave + 1], np.uint64))[0]
        zone = tokens[: _zone(tokens, octave)]
        if octave < 3 or not len(self.frequent):
            rare, rest, k = tokens[:need], tokens[:0], np.empty(0, np.int64)
            if octave < 3:  # too small for combinations: the rarest single tokens
                rare = self._rarest_first(tokens)[:need]
            return _mixed(rare ^ salt), rest, 1.0
        at = np.minimum(np.searchsorted(self.frequent, zone), len(self.frequent) - 1)
        common = self.frequent[at] == zone
        rare = zone[~common]
        share = len(rare) / max(len(zone), 1)
        if len(rare) >= need:
            return _mixed(rare[:need] ^ salt), tokens[:0], share
        # frequent ones by class, then what was not counted, as pairs
        k = self.k[at[common]]
        order = np.argsort(k, kind="stable")
        rest = np.concatenate([zone[common][order], tokens[len(zone) :]])
        k = np.concatenate([k[order], np.full(len(tokens) - len(zone), 2)])
        groups = max(1, round(0.2 * (1 << octave) / GROUP))
        group = (_mixed(rest ^ _MIX[2]) % np.uint64(groups)).astype(np.int64) * 4 + k
        by_group = np.argsort(group, kind="stable")
        sorted_group = group[by_group]
        heads = np.flatnonzero(np.diff(sorted_group, prepend=-1))
        place = np.arange(len(rest)) - np.repeat(heads, np.diff(np.append(heads, len(rest))))
        counts = np.zeros(len(rest), bool)
        counts[by_group] = place >= k[by_group] - 1  # a group's first k - 1 tokens promise nothing
        length = int(np.searchsorted(np.cumsum(counts), need - len(rare))) + 1
        taken = by_group[by_group < length]
        out = []
        for own in np.split(taken, np.flatnonzero(np.diff(group[taken])) + 1):
            size = int(k[own[0]]) if len(own) else 0
            if size and len(own) >= size:
                picks = np.array(list(combinations(range(len(own)), size)))
                out.append(_mixed(rest[own] * _MIX[3])[picks].sum(axis=1, dtype=np.uint64) + np.uint64(size))
        combined = np.concatenate(out) if out else tokens[:0]
        return _mixed(rare ^ salt), _mixed(_mixed(combined) ^ salt ^ _MIX[4]), share

    def _rarest_first(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return tokens
        at = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
        return tokens[np.argsort(np.where(self.frequent[at] == tokens, self.k[at], 1), kind="stable")]


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema)


def _per_set(docs: DataFrame, keys: list[str], text: str, gram: int, seed: int, schema: str, make) -> DataFrame:
    """Columns that ``make(sets, classes, new)`` gives, after ``keys``; a set is new where its class comes first in a task."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at, sets, ids, size = [], [], [], 0
            for i, tokens in enumerate(token_sets(batch.column("__text").cast(pa.large_binary()), gram)):
                at.append(i)
                sets.append(tokens)
                ids.append(_class_of(tokens, seed))
                size += len(tokens)
                if size >= CHUNK:
                    yield made(batch, at, sets, ids, seen)
                    at, sets, ids, size = [], [], [], 0
            yield made(batch, at, sets, ids, seen)

    def made(batch, at, sets, ids, seen) -> pa.RecordBatch:
        new = [len(s) > 0 and not (c in seen or seen.add(c)) for c, s in zip(ids, sets)]
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int64())) for k in keys), *make(sets, ids, new)], names=names)

    rows = docs.select(*keys, F.col(text).cast("string").alias("__text"))
    schema = _kinds(docs, keys) + schema
    names = [*keys, *(part.split()[0] for part in schema.split(", ")[len(keys) :])]
    return rows.mapInArrow(run, schema)


def _per_class(sets: DataFrame, schema: str, make) -> DataFrame:
    """Columns that ``make(sets, classes)`` gives for the written sets; a class may be there more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, ids, size = [], [], 0
            for cls, tokens in zip(batch.column("cls"), batch.column("tokens")):
                held.append(np.frombuffer(tokens.as_buffer(), np.uint64))
                ids.append(cls.as_py())
                size += len(held[-1])
                if size >= CHUNK:
                    yield made(held, ids)
                    held, ids, size = [], [], 0
            if held:
                yield made(held, ids)

    def made(held, ids) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(make(held, ids), names=names)

    names = [part.split()[0] for part in schema.split(", ")]
    return sets.select("cls", "tokens").filter("tokens is not null").mapInArrow(run, schema)


def _numbers(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _facts(docs: DataFrame, keys: list[str], text: str, gram: int) -> DataFrame:
    """``keys, n, cls, bits, tokens`` of every row; different sets have different classes.

    ``tokens`` is NULL for an empty set, and where a task has written the set of this class before.
    """
    seed = 0
    while True:

        def make(sets, ids, new):
            other = [_class_of(s, seed + 1) for s in sets]
            bits = [sketch(s).tobytes() if len(s) else None for s in sets]
            tokens = [s.tobytes() if x else None for s, x in zip(sets, new)]
            numbers = [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], ids, other)]
            return [*numbers, pa.array(bits, pa.binary()), pa.array(tokens, pa.binary())]

        schema = "n bigint, cls bigint, cls2 bigint, bits binary, tokens binary"
        rows = materialize(_per_set(docs, keys, text, gram, seed, schema, make), "sets")
        if rows.groupBy("cls").agg(F.min("cls2").alias("a"), F.max("cls2").alias("b")).filter("a <> b").isEmpty():
            return rows.drop("cls2")
        seed += 2


def frequent_tokens(rows: DataFrame, percent: int, rare: int = RARE, limit: int = FREQUENT) -> Prefixes:
    """Counts the tokens that prefixes can need, over all sets; at most ``limit`` tokens reach the driver."""

    def make(sets, ids):
        parts = [s[: max(_zone(s, o) for o in _octaves(len(s), percent))] for s in sets]
        return [_numbers(np.concatenate(parts) if parts else [])]

    counts = _per_class(rows, "token bigint", make).groupBy("token").count()
    counts = materialize(counts.filter(F.col("count") > rare), "frequent")
    power = F.floor(F.log2(F.col("count"))).cast("int")
    held, least = 0, rare + 1
    for p, n in sorted(counts.groupBy(power.alias("p")).count().collect(), reverse=True):
        if held + n > limit:
            least = 1 << (p + 1)
            break
        held += n
    found = counts.filter(F.col("count") >= least).toArrow()
    token, df = found.column("token").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(token)
    return Prefixes(token[order], np.where(df[order] > TRIPLES * least, 3, 2), percent)


def _buckets(rows: DataFrame, prefixes: Prefixes) -> DataFrame:
    """``sig, cls, hub`` of all buckets with different sets; a bucket of frequent tokens may be of any size."""

    def rows_of(single: bool):
        def make(sets, ids):
            sig, cls, share = [], [], []
            for s, c in zip(sets, ids):
                for octave in _octaves(len(s), prefixes.percent):
                    keys = prefixes.keys(s, octave)
                    own = keys[0 if single else 1]
                    sig.append(own)
                    cls.append(np.full(len(own), c, np.int64))
                    share.append(np.full(len(own), int(1000 * keys[2]), np.int32))
            join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
            out = [_numbers(join(sig, np.uint64)), pa.array(join(cls, np.int64))]
            return out if single else [*out, pa.array(join(share, np.int32))]

        schema = "sig bigint, cls bigint" + ("" if single else ", share int")
        return _per_class(rows, schema, make)

    bucket = Window.partitionBy("sig")  # rare tokens: no more than RARE documents
    rare = rows_of(True).select("sig", "cls", F.min("cls").over(bucket).alias("hub"), F.max("cls").over(bucket).alias("top"))
    rare = rare.filter("hub <> top").drop("top")
    if not len(prefixes.frequent):
        return materialize(rare, "buckets")
    common = materialize(rows_of(False), "combinations")
    # the hub is the set with the fewest rare tokens: of near copies, that which the others were made from
    hubs = common.groupBy("sig").agg(
        F.min(F.struct("share", "cls")).alias("hub"), F.min("cls").alias("low"), F.max("cls").alias("top")
    )
    hubs = hubs.filter("low <> top").select("sig", F.col("hub.cls").alias("hub"))
    return materialize(rare.unionByName(common.select("sig", "cls").join(hubs, "sig").distinct()), "buckets")


def _sieve(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` that sizes and bitmaps let pass."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    near = f"{percent} * greatest(n_a, n_b) <= 100 * least(n_a, n_b)"
    rows = pairs.join(side("a"), "a").join(side("b"), "b").filter(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            differing = np.empty(len(n), np.int64)
            for i, (x, y) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                words = min(len(x), len(y))
                differing[i] = np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum()
            keep = pa.array(_may_link(n, m, differing, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)

    return rows.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` that link, by their full sets."""
    wanted = materialize(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), "wanted")
    n_wanted = wanted.count()
    if not n_wanted:
        return pairs

    def make(sets, ids):
        ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
        return [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), _numbers(np.concatenate(sets)))]

    held = rows.select("cls", "tokens").join(F.broadcast(wanted) if n_wanted <= WANTED else wanted, "cls", "left_semi")
    sets = _per_class(held, "cls bigint, tokens array<bigint>", make).dropDuplicates(["cls"])
    sets = materialize(sets, "tokens")
    side = lambda x: sets.select(F.col("cls").alias(x), F.col("tokens").alias(f"t_{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("t_a", "t_b"))
    enough = (100 + percent) * both >= percent * (F.size("t_a") + F.size("t_b"))
    return materialize(met.filter(enough).select("a", "b"), "links")


class _Bitmaps:
    """The bitmaps of a table's rows, each also folded to every shorter length that another row has."""

    def __init__(self, maps: list[bytes]) -> None:
        self.words = np.array([len(m) // 8 for m in maps])
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        longer, rows = np.empty((0, 0), np.uint64), np.empty(0, np.int64)
        for w in np.unique(self.words)[::-1].tolist():
            while len(rows) and longer.shape[1] > w:
                longer = longer[:, : longer.shape[1] // 2] ^ longer[:, longer.shape[1] // 2 :]
            own = np.flatnonzero(self.words == w)
            here = np.frombuffer(b"".join([maps[i] for i in own.tolist()]), np.uint64).reshape(-1, w)
            longer, rows = np.concatenate([longer, here]) if len(rows) else here, np.append(rows, own)
            place = np.zeros(len(maps), np.int64)
            place[rows] = np.arange(len(rows))
            self.folded[w] = longer, place

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differing bits of rows ``i`` and ``j``, at the length of the shorter bitmap."""
        out, shorter = np.empty(len(i), np.int64), np.minimum(self.words[i], self.words[j])
        for w, (maps, place) in self.folded.items():
            chosen = np.flatnonzero(shorter == w)
            step = max(1, CHUNK // w)
            for at in range(0, len(chosen), step):
                own = chosen[at : at + step]
                bits = np.bitwise_count(maps[place[i[own]]] ^ maps[place[j[own]]])
                out[own] = bits.sum(axis=1, dtype=np.int64)
        return out


def _close_pairs(table: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs of whole buckets ``(sig, x, y)`` that lie in different components and may link.

    Rows are compared with those ``d`` places behind, for all buckets at once. ``first`` are a set's first buckets: a pair
    that shares one below this bucket was compared there.
    """
    sig, root, n = (table.column(c).to_numpy() for c in ("sig", "root", "n"))
    heads = group_heads(table, ["sig", "x", "y"])
    sizes = np.diff(heads, append=table.num_rows)
    left = np.repeat(heads + sizes, sizes) - np.arange(table.num_rows)
    maps = _Bitmaps(table.column("bits").to_pylist())
    first = table.column("first").combine_chunks()
    counts = first.value_lengths().to_numpy()
    before = np.full((len(n), FIRST), np.iinfo(np.int64).max)
    before[np.arange(FIRST) < counts[:, None]] = first.flatten().to_numpy()

    def passed(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        i, j = (np.concatenate(x) for x in zip(*pairs))
        close = _may_link(n[i], n[j], maps.differing(i, j), percent)
        i, j = i[close], j[close]
        for at in range(0, len(i), CHUNK // FIRST**2):
            a, b = i[at : at + CHUNK // FIRST**2], j[at : at + CHUNK // FIRST**2]
            earlier = before[a] < sig[a, None]
            known = ((before[a][:, :, None] == before[b][:, None, :]) & earlier[:, :, None]).any(axis=(1, 2))
            yield a[~known], b[~known]

    held, size = [], 0
    rows = np.flatnonzero(left > 1)
    d = 1
    while len(rows):
        i, j = rows, rows + d
        may = (root[i] != root[j]) & (percent * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j]))
        held.append((i[may], j[may]))
        size += len(held[-1][0])
        if size >= CHUNK:
            yield from passed(held)
            held, size = [], 0
        d += 1
        rows = rows[left[rows] > d]
    if held:
        yield from passed(held)


def _across(members: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs ``a, b`` of different components in one bucket that sizes and bitmaps let pass."""
    members = members.withColumn("blocks", F.ceil(F.col("size") / block).cast("bigint"))
    members = members.withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: (F.col("blocks") == 1) | (j != F.col("mine")))
    members = members.withColumn("other", F.explode(others))
    x, y = F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")
    rows = members.select("sig", x, y, "cls", "root", "n", "bits", "first").repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["sig", "x", "y"]):
            cls = table.column("cls").to_numpy()
            for i, j in _close_pairs(table, percent):
                a, b = np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _open_buckets(met: DataFrame, links: DataFrame) -> DataFrame:
    """``sig, size, cls, root`` of buckets with more than one component; buckets of the same sets are kept once."""
    roots = materialize(components(links).withColumnRenamed("node", "cls"), "roots")
    met = met.join(roots, "cls", "left").select("sig", "cls", F.coalesce("root", "cls").alias("root"))
    met = materialize(met, "met")
    mix = F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("mix")
    open_ = met.groupBy("sig").agg(mix, F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("top"))
    open_ = open_.filter("low <> top").groupBy("mix", "size").agg(F.min("sig").alias("sig"))
    return met.join(open_.select("sig", "size"), "sig")


def jaccard_groups(
    docs: DataFrame,
    keys: list[str],
    text: str = "text",
    gram: int = GRAM,
    percent: int = PERCENT,
    rare: int = RARE,
    block: int = BLOCK,
) -> DataFrame:
    """``keys, n_shingles, component_id``: size of the set, and the smallest first key reachable over links."""
    ship_package(docs.sparkSession)
    rows = _facts(docs, keys, text, gram)
    prefixes = frequent_tokens(rows, percent, rare)
    met = _buckets(rows, prefixes)
    classes = rows.filter("n > 0").groupBy("cls").agg(F.min(keys[0]).alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = materialize(classes, "classes")

    # against the hub of each bucket first
    hub = lambda rows: rows.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()
    tried = materialize(_sieve(hub(met.filter("cls <> hub")), classes, percent), "hub-pairs")
    links = _verified(tried, rows, percent)
    members = materialize(_open_buckets(met.select("sig", "cls"), links), "open")

    # where components still meet, against a set drawn for each bucket: near copies meet in many, so most of them join
    drawn = members.groupBy("sig").agg(F.min(F.struct(F.xxhash64("sig", "cls"), "cls", "root")).alias("d"))
    drawn = drawn.select("sig", F.col("d.cls").alias("hub"), F.col("d.root").alias("hub_root"))
    pairs = hub(members.join(drawn, "sig").filter("root <> hub_root")).join(tried, ["a", "b"], "left_anti")
    again = materialize(_sieve(pairs, classes, percent), "drawn-pairs")
    links = links.unionByName(_verified(again, rows, percent))
    tried = tried.unionByName(again)

    # then the sets of different components that still meet
    members = materialize(_open_buckets(members.select("sig", "cls"), links), "open")
    first = F.slice(F.sort_array(F.collect_list("sig")), 1, FIRST).alias("first")
    facts = classes.select("cls", "n", "bits").join(members.groupBy("cls").agg(first), "cls")
    rest = _across(members.join(facts, "cls"), percent, block).join(tried, ["a", "b"], "left_anti")
    rest = materialize(rest, "rest")
    links = links.unionByName(_verified(rest, rows, percent))

    linked = components(links).select(F.col("node").alias("cls"), "root")
    root = F.coalesce("root", "cls").alias("root")
    named = classes.select("cls", "least").join(linked, "cls", "left").select("cls", root, "least")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(smallest, "root").select("cls", "component_id"), "components")
    # an empty set has no class here, and is its own component
    own = F.when(F.col("n") == 0, F.col(keys[0])).otherwise(F.col("component_id")).alias("component_id")
    return rows.join(named, "cls", "left").select(*keys, F.col("n").alias("n_shingles"), own)
