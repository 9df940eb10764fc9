"""Token text by byte ranges against a plain split of the whole text."""

import random

import pytest
from conftest import answers

from boughs.functions.algebra import max_path_sum
from boughs.plans.fold import fold_tree
from boughs.sources import ranges


def _tokens(df):
    trees = {}
    for r in df.orderBy("tree_id", "chunk_id").collect():
        assert len(r.tokens) > 0
        trees.setdefault(r.tree_id, []).extend(r.tokens)
    return trees


def _text(rng, n):
    words = ["/", "é", "12", "-5", "x" * 40, "ab", "ü" * 9]
    gaps = [" ", "  ", "\n", "\r\n", "\n\n ", " "]
    return "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n))


def test_any_cut_gives_the_tokens_of_the_text(spark, tmp_path):
    rng = random.Random(5)
    texts = {f"tree_id={t}/f{i}.in": _text(rng, 30 * i) for t in (1, 2, 10) for i in range(3)}
    texts["tree_id=2/g.in"] = "   \n \n"
    texts["tree_id=3/one.in"] = "y" * 500 + " z"
    texts["tree_id=3/two.in"] = "w" * 100
    want = {}
    for name in sorted(texts):
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_bytes(texts[name].encode())
        if texts[name].split():
            want.setdefault(int(name[8:].split("/")[0]), []).extend(texts[name].split())
    for range_bytes, chunk_bytes in ((1, 1), (7, 3), (64, 16), (1 << 20, 1 << 10)):
        got = ranges.read_token_ranges(spark, str(tmp_path), range_bytes, chunk_bytes)
        assert _tokens(got) == want
        assert got.groupBy("tree_id", "chunk_id").count().filter("count > 1").isEmpty()


def test_chunks_do_not_depend_on_the_ranges(spark, tmp_path):
    (tmp_path / "a b%.in").write_text(_text(random.Random(6), 200))
    one = ranges.read_token_ranges(spark, str(tmp_path), 32, 32).collect()
    two = ranges.read_token_ranges(spark, str(tmp_path), 1 << 20, 32).collect()
    assert sorted(one) == sorted(two) and len(one) > 10 and {r.tree_id for r in one} == {0}


def test_one_line_tree_is_folded_from_many_ranges(spark, tmp_path):
    n = 2000
    (tmp_path / "t.in").write_text(" ".join(["1"] * n + ["/"] * n))
    chunks = ranges.read_token_ranges(spark, str(tmp_path), 256, 64)
    assert chunks.count() > 50
    assert answers(fold_tree(chunks, max_path_sum, entry_limit=256)) == {0: n}


def test_empty_and_refused_files(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.in").write_text("")
    assert ranges.read_token_ranges(spark, str(tmp_path / "e")).collect() == []
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "x.in.gz").write_bytes(b"\x1f\x8b")
    with pytest.raises(Exception, match="compressed"):
        ranges.read_token_ranges(spark, str(tmp_path / "g")).collect()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.in").write_bytes(b"\xff\xfe 1")
    with pytest.raises(Exception):  # noqa: B017
        ranges.read_token_ranges(spark, str(tmp_path / "b")).collect()
