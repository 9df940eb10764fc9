import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import brute
from llm.conftest import rows_of

from boughs.llm import ngram_join as nj


def test_groups_of_documents(docs):
    want = brute.jaccard_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(nj.jaccard_groups(docs, ["doc_id"]), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_empty_table(nothing):
    assert nj.jaccard_groups(nothing, ["doc_id"]).collect() == []


def _copies(rng, n, words, edits):
    base = [f"b{rng.randrange(5000)}" for _ in range(words)]
    out = [base]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        out.append(copy[: len(copy) - rng.randint(0, edits)])
    return [" ".join(c) for c in out]


@pytest.mark.parametrize("rare, block", [(64, 2048), (2, 7), (0, 3)])
def test_near_copies_of_all_sizes(spark, rare, block):
    """Groups around the bound, with frequent tokens in pairs and triples and buckets in blocks."""
    rng = random.Random(rare)
    texts = [t for words in (1, 2, 4, 6, 9, 13, 30, 64, 130, 300, 700) for t in _copies(rng, 25, words, max(1, words // 20))]
    common = " ".join(f"c{i}" for i in range(40))
    texts += [common + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(k)) for k in (0, 1, 3, 5, 8, 200) for _ in range(12)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = nj.jaccard_groups(docs, ["doc_id"], rare=rare, block=block)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_groups(rows), key=repr)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 900), st.integers(0, 10**6), st.floats(0, 1), st.integers(1, 3))
def test_linked_sets_share_a_key_and_pass_the_sieve(n, seed, frequent_share, kind):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**64, n, np.uint64))
    drop = rng.integers(0, max(1, int(0.15 * len(x)) + 1))
    y = np.delete(x, rng.choice(len(x), min(drop, len(x) - 1), replace=False))
    while 100 * len(y) >= 85 * (len(x) + 1) and rng.random() < 0.7:
        x = np.unique(np.append(x, rng.integers(0, 2**64, 1, np.uint64)))
    common = len(np.intersect1d(x, y))
    linked = 100 * common >= 85 * (len(x) + len(y) - common)
    both = np.union1d(x, y)
    frequent = both[rng.random(len(both)) < frequent_share]
    k = np.full(len(frequent), kind) if kind > 1 else rng.integers(2, 4, len(frequent))
    p = nj.Prefixes(frequent, k)
    octaves = set(nj._octaves(len(x), 85)) & set(nj._octaves(len(y), 85))
    keys = lambda s: {(o, int(v)) for o in octaves for part in p.keys(s, o)[:2] for v in part}
    bx, by = nj.sketch(x), nj.sketch(y)
    words = min(len(bx), len(by))
    differing = int(np.bitwise_count(nj._folded(bx, words) ^ nj._folded(by, words)).sum())
    assert differing <= len(x) + len(y) - 2 * common
    if linked:
        assert keys(x) & keys(y)
        assert nj._may_link(len(x), len(y), differing, 85)


def test_keys_stay_in_proportion():
    x = np.sort(np.random.default_rng(1).integers(0, 2**64, 20_000, np.uint64))
    single, combined, _ = nj.Prefixes(x, np.full(len(x), 2)).keys(x, 14)
    assert not len(single) and len(combined) < len(x)


def test_texts_are_cut_into_sets_once(spark, monkeypatch):
    """Counts, buckets and checks read the written sets, not the texts again."""
    made, per_set = [], nj._per_set
    monkeypatch.setattr(nj, "_per_set", lambda *a: made.append(a) or per_set(*a))
    rng = random.Random(3)
    rows = list(enumerate(t for n in (8, 40, 200) for t in _copies(rng, 12, n, max(1, n // 20))))
    got = nj.jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"], rare=2)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_groups(rows), key=repr)
    assert len(made) == 1


def test_close_pairs_of_buckets():
    """All pairs of each bucket, whatever its size, without those of one component or known from an earlier bucket."""
    rng = np.random.default_rng(2)
    rows = []
    for sig, size in enumerate([1, 2, 40, 3, 9, 700]):
        for i in range(size):
            n = int(rng.integers(1, 400))
            tokens = np.unique(rng.integers(0, 2**64, n, np.uint64) if i % 3 else np.arange(1, n + 1).astype(np.uint64))
            first = sorted({sig, *rng.integers(-40, 10, rng.integers(1, nj.FIRST)).tolist()})[: nj.FIRST]
            rows.append({"sig": sig, "x": 0, "y": 0, "root": int(rng.integers(0, 5)), "n": len(tokens), "bits": nj.sketch(tokens).tobytes(), "first": first})
    want = set()
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if a["sig"] == b["sig"] and a["root"] != b["root"]:
                x, y = (np.frombuffer(r["bits"], np.uint64) for r in (a, b))
                words = min(len(x), len(y))
                differing = int(np.bitwise_count(nj._folded(x, words) ^ nj._folded(y, words)).sum())
                known = {s for s in a["first"] if s < a["sig"]} & set(b["first"])
                if nj._may_link(a["n"], b["n"], differing, 85) and not known:
                    want.add((i, j))
    table = nj.pa.Table.from_pylist(rows)
    got = [(int(i), int(j)) for x, y in nj._close_pairs(table, 85) for i, j in zip(x, y)]
    assert len(got) == len(set(got)) and set(got) == want and want
