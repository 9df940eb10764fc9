from llm import brute
import corpus_pipeline
import pytest
from llm.test_quality import _buckets

from boughs.llm import quality

ITEM = "zero knowledge proofs let one party show a fact to another party without telling it"
LONG = " ".join(f"word{i}" for i in range(60))


def _corpus(spark, tmp_path, rows):
    documents = spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, size int"
    )
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(40), 100, 101, 102, 103]] + [(106, 0, 0)], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([(0, ITEM)], "item_id bigint, text string")
    for name, table in (("documents", documents), ("labels", labels), ("benchmark", benchmark)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    return documents


def _rows():
    def row(i, text, source):
        return i, text, "en", source, len(text or ""), None, 7

    rows = []
    for i in range(40):
        words = " ".join(f"{a}{(i * 7 + j) % 53}" for j, a in enumerate("abcdefghijklmnopqrstuvwxyzabcd"))
        rows.append(row(i, f"menu home about\n{words}\nend of {i}", f"src{i % 2}"))
    rows += [row(100, rows[0][1], "src0"), row(101, rows[0][1].upper(), None), rows[3], row(102, LONG, "src1")]
    rows += [row(103, f"{LONG} {ITEM.upper()}. {LONG[::-1]}", "src0"), row(104, None, "src0"), row(105, "too short", None)]
    rows += [row(106, "spam " * 200, "src1"), (None, rows[5][1] + " more", None, None, None, None, None)]
    return rows


def test_stages_equal_plain_definitions(spark, tmp_path):
    docs = _corpus(spark, tmp_path, _rows())
    plain, columns = [tuple(r) for r in docs.collect()], docs.columns
    by = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash_dedup", "decontamination", "mixing",
    ]

    out = by["quality_rules"](spark, docs, str(tmp_path))
    assert out.columns == columns
    weights = quality.bucket_weights(docs, quality.trusted_ids(spark.read.parquet(f"{tmp_path}/labels.parquet")))

    def kept(text):
        b = _buckets(text, quality.BUCKETS)
        score = sum(weights[x] for x in b) / len(b) / 1e6 if b else 0
        return not brute.base_quality(text)[-1] and score >= quality.THRESHOLD

    plain = [r for r in plain if kept(r[1])]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(plain, key=repr)
    assert {104, 105, 106}.isdisjoint(r[0] for r in plain) and {0, 100} <= {r[0] for r in plain}

    out = by["line_dedup"](spark, spark.createDataFrame(plain, docs.schema), str(tmp_path))
    assert out.columns == columns
    cleaned = brute.line_dedup([(r[3], r[1]) for r in plain])
    plain = [(r[0], t, r[2], r[3], len(t) if n else r[4], *r[5:]) for r, (t, _, n) in zip(plain, cleaned)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(plain, key=repr)
    assert any(n for *_, n in cleaned)

    out = by["simhash_dedup"](spark, spark.createDataFrame(plain, docs.schema), str(tmp_path))
    assert out.columns == columns
    groups = brute.groups([(r[0], brute.fingerprint(r[1])) for r in plain])
    firsts = {c for _, _, c in groups}
    got = [tuple(r) for r in out.collect()]
    assert sorted((r[0] for r in got), key=repr) == sorted(firsts, key=repr)
    assert 100 not in firsts and 101 not in firsts
    assert set(got) <= set(plain)

    out = by["decontamination"](spark, spark.createDataFrame(got, docs.schema), str(tmp_path))
    assert out.columns == columns
    plain = [r for r in got if not brute.contamination([(0, r[1])], [(0, ITEM)])[0][2]]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(plain, key=repr)
    assert 103 in {r[0] for r in got} and 103 not in {r[0] for r in plain}

    out = by["mixing"](spark, spark.createDataFrame(plain, docs.schema), str(tmp_path)).collect()
    assert sorted((r.doc_id, r["size"]) for r in out if r.doc_id is not None) == sorted(
        (r[0], len(brute.words(r[1]))) for r in plain if r[0] is not None
    )
    for s in {r.source for r in out}:
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole), key=repr) == sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_no_documents(spark, tmp_path, stage):
    docs = _corpus(spark, tmp_path, _rows()[:1]).filter("false")
    assert stage(spark, docs, str(tmp_path)).collect() == []
