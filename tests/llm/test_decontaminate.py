from llm import brute
from llm.conftest import BASE, rows_of

from boughs.llm import decontaminate

ITEMS = [
    (0, BASE),
    (1, "SEVEN eight, nine: ten eleven twelve thirteen fourteen fifteen sixteen"),
    (1, "seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"),
    (2, "café"),
    (3, "short text"),
    (4, None),
    (5, ""),
    (6, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"),
    (None, "different words"),
    (8, "not in any document at all whatever happens to be there now"),
]


def _items(spark, rows=ITEMS):
    return spark.createDataFrame([(i, t, 3) for i, t in rows], "item_id bigint, text string, n_hit int")


def _want(docs, items):
    return sorted(brute.contamination([(r.doc_id, r.text) for r in docs.collect()], items), key=repr)


def _got(out):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in out.collect()), key=repr)


def test_windows_and_short_items(spark, docs):
    out = decontaminate.contamination(docs, _items(spark), ["doc_id"])
    assert _got(out) == _want(docs, ITEMS)


def test_a_small_filter_and_other_shingles_change_nothing(spark, docs):
    for shingle in (1, 3, 12):
        out = decontaminate.contamination(docs, _items(spark), ["doc_id"], shingle=shingle, bits=8)
        assert _got(out) == _want(docs, ITEMS)


def test_empty_tables(spark, docs, nothing):
    assert decontaminate.contamination(nothing, _items(spark), ["doc_id"]).collect() == []
    assert _got(decontaminate.contamination(docs, _items(spark, []), ["doc_id"])) == _want(docs, [])


def test_contaminated_documents_go(spark, docs):
    kept = decontaminate.drop_contaminated(docs, _items(spark))
    assert kept.columns == docs.columns
    clean = [(r.doc_id, r.text) for r in docs.collect() if not brute.contamination([(0, r.text)], ITEMS)[0][2]]
    assert rows_of(kept, "doc_id", "text") == sorted(clean, key=repr)
