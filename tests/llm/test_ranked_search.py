import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import brute
from llm.conftest import TEXTS

from boughs.llm import ranked_search as rs

ITEMS = [(1, "one two three one"), (2, "word words nine"), (3, None), (4, ""), (5, "w3 w976 spam Eggs über"), (5, "one two"), (None, "totally"), (7, "unknown")]


def _found(docs, items, segment=rs.SEGMENT, k=10, batch=rs.ITEMS):
    out = rs.search(rs.build_index(docs, segment=segment), items, k=k, batch=batch)
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("segment, batch", [(rs.SEGMENT, 256), (40, 2)])
def test_against_all_scores(spark, docs, segment, batch):
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in ITEMS], "item_id bigint, text string, rank int, score bigint")
    want = brute.ranked([(r.doc_id, r.text) for r in docs.collect()], ITEMS, 10)
    assert _found(docs, items, segment, batch=batch) == sorted(want, key=repr)


def test_empty_tables(spark, docs, nothing):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert _found(nothing, items) == []
    assert _found(docs, items.filter("false")) == []


def test_a_large_segment_prunes_and_keeps_ties(spark):
    rng = random.Random(2)
    common = ["the", "of", "and", "to"]
    texts = [" ".join(rng.choices(common, k=30) + rng.choices([f"t{i}" for i in range(400)], k=rng.randint(1, 20))) for _ in range(1500)]
    texts += ["rare the the"] * 30  # equal scores: the smaller ids stay
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    items = [(0, "the rare t3"), (1, "of and to t7 t7"), (2, "the of and to"), (3, "t1 t2 t3 t4 t5 the")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = _found(docs, spark.createDataFrame(items, "item_id bigint, text string"), segment=9000, k=7)
    assert got == sorted(brute.ranked(rows, items, 7), key=repr)


class _Untouched(rs.PostingList):
    def block(self, b):
        raise AssertionError("decompressed")


def test_candidates_are_rejected_before_decompression():
    docs = np.arange(300)
    _, _, lists = rs._posting_lists(np.zeros(300, np.int64), docs, np.ones(300, np.int64), np.full(300, 10))
    norm = np.full(300, 100)
    strong = rs.PostingList(lists[0].as_py(), 1000, norm, lambda n: np.full(len(n), 100))
    weak = _Untouched(lists[0].as_py(), 1, norm, lambda n: np.full(len(n), 100))
    heap = rs.Heap(2)
    heap.add(np.array([strong.bound * 2, strong.bound * 2]), np.array([1, 2]), np.zeros(2, bool))
    rs.max_score([(weak, 1), (strong, 1)], heap, 0, 300, docs, np.zeros(300, bool))
    assert heap.ids.tolist() == [1, 2]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 100_000), st.integers(1, 70_000)), min_size=1, max_size=400))
def test_postings_and_block_maxima(rows):
    post = sorted({(t, d): tf for t, d, tf in rows}.items())
    term, doc, tf = (np.array(x, np.int64) for x in ([k[0] for k, _ in post], [k[1] for k, _ in post], [v for _, v in post]))
    lengths = np.arange(100_001) % 977 + 1
    head, df, lists = rs._posting_lists(term, doc, tf, lengths)
    norm = 25 + lengths
    for t, n, data in zip(head, df, lists):
        p = rs.PostingList(data.as_py(), 3, norm, lambda x: 25 + x)
        docs, parts = p.all()
        own = term == t
        assert n == own.sum() and docs.tolist() == doc[own].tolist()
        assert parts.tolist() == rs.impact(3, tf[own], norm[doc[own]]).tolist()
        assert p.block_max.tolist() == [int(p.block(b)[1].max()) for b in range(len(p.last))]


def test_terms():
    assert rs.terms("Größe ÄB_c-3".encode()) == ["größe".encode(), "Äb".encode(), b"c", b"3"]
    assert rs.terms(None) == [] and pa.array([TEXTS[4]])[0].as_py()
