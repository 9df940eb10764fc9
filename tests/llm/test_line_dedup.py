from llm import brute

from boughs.llm import line_dedup


def _compare(pages, host, ratio, least):
    rows = pages.collect()
    want = brute.line_dedup([(r[host], r.text) for r in rows], ratio, least)
    got = line_dedup.drop_boilerplate(pages, host, "text", ratio, least).collect()
    assert sorted(((r[host], r.text, *r["__cut"]) for r in got), key=repr) == sorted(
        ((r[host], *w) for r, w in zip(rows, want)), key=repr
    )
    return sum(w[2] for w in want)


def test_documents(docs):
    assert _compare(docs, "source", 0.1, 2) > 0
    assert _compare(docs, "source", 0.9, 5) == 0


def test_ratio_is_relative_to_the_host(spark):
    rows = [("big", f"menu\ntext {i}\n\n footer {i % 2} ", i) for i in range(40)]
    rows += [("small", f"menu\nother {i}" if i < 3 else f"other {i}", i) for i in range(9)]
    rows += [(None, "menu", 1)] * 6 + [("big", None, 0), ("empty", "", 0)]
    pages = spark.createDataFrame(rows, "host string, text string, n_lines int")
    assert _compare(pages, "host", 0.3, 4) > 0
    assert _compare(pages, "host", 0.5, 4) > 0
    out = line_dedup.drop_boilerplate(pages, "host", "text", 0.5, 4)
    assert out.columns == ["host", "text", "n_lines", "__cut"]


def test_empty_table(nothing):
    assert line_dedup.drop_boilerplate(nothing).collect() == []
