import math
from collections import Counter

from llm import brute
import numpy as np
import pyarrow as pa

from boughs.llm import lm_score, lm_tables
from llm.conftest import BASE


def _tokens(text, vocabulary):
    return [w if w in vocabulary else None for w in brute.words((text or "").translate(brute.UPPER))]


def _plain(docs, target, vocabulary, inventory):
    """Loss of every text under the two models, from counts kept in dictionaries."""

    def model(texts):
        uni, first, bi = Counter(), Counter(), Counter()
        for t in texts:
            w = _tokens(t, vocabulary)
            uni.update(w)
            first.update(w[:-1])
            bi.update(p for p in zip(w, w[1:]) if p in inventory)
        total, size = sum(uni.values()), len(vocabulary) + 1

        def word(w):
            return (uni[w] + 1) / (total + size)

        def pair(h, w):
            kinds = sum(1 for p in bi if p[0] == h)
            inside = sum(n for p, n in bi.items() if p[0] == h)
            if not first[h]:
                return word(w)
            return (bi[h, w] + (kinds + first[h] - inside) * word(w)) / (first[h] + kinds)

        return word, pair

    def loss(text, word, pair):
        w = _tokens(text, vocabulary)
        return sum([-math.log(word(w[0]))] + [-math.log(pair(a, b)) for a, b in zip(w, w[1:])]) / len(w) if w else 0.0

    near, far = model(target), model(docs)
    for word, pair in (near, far):
        everything = [*vocabulary, None]
        assert math.isclose(sum(map(word, everything)), 1)
        assert all(math.isclose(sum(pair(h, w) for w in everything), 1) for h in everything)
    return [(loss(t, *near), loss(t, *far)) for t in docs]


TEXTS = [BASE, BASE.upper() + " one two one two", "one two three one two four", None, "", "unseen words here", "two", "one two " * 50]


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, score int")


def test_scores_equal_plain_counts(spark):
    docs = _docs(spark, [*TEXTS, TEXTS[2]])
    target = docs.filter("doc_id in (0, 2, 6)")
    for v, k in ((6, 5), (50, 100), (3, 0)):
        model = lm_score.fit_inventory(target, "text", v, k)
        names = {i: w.decode() for w, i in model.number.items()}
        inventory = {(names.get(x // model.size), names.get(x % model.size)) for x in model.keys.tolist()}
        want = _plain([*TEXTS, TEXTS[2]], [TEXTS[i] for i in (0, 2, 6)], set(names.values()), inventory)
        got = sorted(lm_score.cross_entropy_difference(docs, target, ["doc_id"], "text", v, k).collect())
        for r, (near, far) in zip(got, want):
            assert math.isclose(r.target_loss, near, abs_tol=1e-9) and math.isclose(r.background_loss, far, abs_tol=1e-9)
            assert math.isclose(r.score, near - far, abs_tol=1e-9)
            assert r.n_tokens == len(brute.words(TEXTS[2] if r.doc_id == len(TEXTS) else TEXTS[r.doc_id]))


def test_counts_do_not_depend_on_partitions(spark, docs):
    target = docs.filter("doc_id = 0")
    a, b = (
        sorted(map(tuple, lm_score.cross_entropy_difference(docs.repartition(n), target, ["doc_id"]).collect()), key=repr)
        for n in (1, 5)
    )
    assert a == b


def test_trusted_documents(spark, docs):
    rows = [(0, 1, 0), (1, 1, 0), (3, 1, 1), (4, 0, 0), (2, 1, 0), (2, 0, 0), (None, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    found = lm_score.trusted_documents(docs, labels)
    assert sorted(r.doc_id for r in found.collect()) == [0, 0, 1] and found.columns == docs.columns


def test_empty_tables(spark, docs, nothing):
    assert lm_score.cross_entropy_difference(nothing, docs, ["doc_id"]).collect() == []
    out = lm_score.cross_entropy_difference(docs, nothing, ["doc_id"]).collect()
    assert len(out) == docs.count() and all(abs(r.score) < 1e-9 for r in out)


def test_long_text_in_blocks():
    model = lm_score.Inventory([b"a", b"b"], np.array([1 * 3 + 2]))
    uni, first, bi = model.count(iter([b"a b " * 600_000, b"b a", None]))
    assert uni.tolist() == [0, 600_001, 600_001] and first.tolist() == [0, 600_000, 600_000] and bi.tolist() == [600_000]


def test_every_word_and_bigram_counts(spark, monkeypatch):
    """No word is unknown and no bigram is left out, however the blocks, buckets and hot words are cut."""
    texts = [*TEXTS, TEXTS[2], " Caf\u00e9\u00a0x\x1cy \t CAF\u00c9 ", *[f"one w{i} two w{i % 7} one" for i in range(40)]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    trusted = [0, 2, 6, 12, 13]
    target = docs.filter(docs.doc_id.isin(trusted))
    words = [_tokens(t, {*brute.words((t or "").translate(brute.UPPER))}) for t in texts]
    vocabulary, inventory = {w for t in words for w in t}, {p for t in words for p in zip(t, t[1:])}
    want = _plain(texts, [texts[i] for i in trusted], vocabulary, inventory)
    for bucket, part in ((1 << 21, 8), (20, 8), (20, 1)):
        monkeypatch.setattr(lm_tables, "BUCKET", bucket)
        monkeypatch.setattr(lm_tables, "HOT_PART", part)
        got = sorted(lm_score.cross_entropy_difference(docs, target, ["doc_id"]).collect())
        labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(1, 1, 1), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
        assert sorted(lm_score.score_by_labels(docs, labels, ["doc_id"]).collect()) == got
        assert [r.doc_id for r in got] == list(range(len(texts)))
        for r, (near, far) in zip(got, want):
            assert math.isclose(r.target_loss, near, abs_tol=1e-9) and math.isclose(r.background_loss, far, abs_tol=1e-9)
            assert r.n_tokens == len(words[r.doc_id])


def test_words_of_a_slice():
    texts = pa.array([f"Word{i} \x0b\x1cÉ\u00a0b\u0085 " * (i % 5) for i in range(100)])
    want = [t.as_py().translate(brute.UPPER).encode().split() for t in texts]
    for start in (0, 3, 50):
        found, sizes = lm_tables.split_words(texts.slice(start))
        assert sizes.tolist() == [len(w) for w in want[start:]]
        assert [w.encode() for w in found.to_pylist()] == [w for t in want[start:] for w in t]
