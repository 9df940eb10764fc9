import math
import struct

from llm import brute
import xxhash

from boughs.llm import quality


def _hash(data, seed=42):
    h = xxhash.xxh64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


def _pair(a, b):
    return _hash(struct.pack("<q", b), _hash(struct.pack("<q", a)) % (1 << 64))


def _buckets(text, n):
    h = [_hash(w.encode()) for w in brute.words(text)]
    return [x % n for x in h] + [_pair(a, b) % n for a, b in zip(h, h[1:])]


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_base_rules_and_scores(spark, docs):
    labels = _labels(spark, [(0, 1, 0), (3, 1, 0), (4, 1, 0), (4, 0, 0), (10, 1, 1), (None, 1, 0), (12, 0, 0), (99, 1, 0)])
    trusted = quality.trusted_ids(labels)
    assert sorted(r.doc_id for r in trusted.collect()) == [0, 3, 10, 99]
    n = 64
    weights = quality.bucket_weights(docs, trusted, n)
    raw, target = [1] * n, [1] * n
    rows = docs.collect()
    for r in rows:
        for b in _buckets(r.text, n):
            raw[b] += 1
            target[b] += r.doc_id in (0, 3, 10)
    assert weights == [
        round(1e6 * (math.log(t / sum(target)) - math.log(r / sum(raw)))) for t, r in zip(target, raw)
    ]
    out = quality.quality_rules(docs, weights, threshold=-0.05, buckets=n)
    assert out.columns == [*docs.columns, "__quality"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        q = r["__quality"]
        want = brute.base_quality(r.text)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == want
        b = _buckets(r.text, n)
        assert math.isclose(q.score, sum(weights[x] for x in b) / len(b) / 1e6 if b else 0, abs_tol=1e-12)
        assert q.kept == (not want[-1] and q.score >= -0.05)


def test_filter_on_the_verdict_keeps_the_facts(spark, docs):
    out = quality.quality_rules(docs, [0] * quality.BUCKETS)
    assert out.filter("__quality.kept").count() == sum(not brute.base_quality(r.text)[-1] for r in docs.collect())


def test_no_labels_and_no_documents(spark, docs, nothing):
    none = quality.trusted_ids(_labels(spark, []))
    assert quality.bucket_weights(docs, none, 16) == [0] * 16
    assert quality.quality_rules(nothing, [0] * quality.BUCKETS).collect() == []


def test_no_python_in_the_plan(spark, docs):
    plan = quality.quality_rules(docs, [0] * quality.BUCKETS)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_toxic_documents_are_not_a_target(spark):
    rows = [(0, 1, 0), (1, 1, 1), (2, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, 0), (4, 0, 0), (None, 1, 0), (5, 1, 0), (5, 1, 0)]
    assert sorted(r.doc_id for r in quality.clean_ids(_labels(spark, rows)).collect()) == [0, 5]
