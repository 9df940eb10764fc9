"""The ordered product over brackets from chunk files: sibling order at any height, in bounded groups."""

import random
from dataclasses import replace

import pytest
from conftest import CHUNKS, answers, chunk_rows, random_cuts, random_tokens, strict_fold
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boughs.catalog.queries import order_hash
from boughs.functions.algebra import ColumnForm, TreeAlgebra, WrapForm
from boughs.operators.match import BLOCK_BITS
from boughs.operators.partials import chunk_partial, chunk_shape
from boughs.plans import fold, levels, ordered
from boughs.plans.pairs import chunk_depth

words = TreeAlgebra(
    name="words",
    value_type=T.StringType(),
    result_type=T.StringType(),
    hom=lambda a: f"<{a}>",
    plus=lambda a, s: f"{a}({s})",
    mult=lambda x, y: x + y,
    parse=str,
    parse_col=lambda t: t,
    column=ColumnForm(
        hom=lambda a: F.concat(F.lit("<"), a, F.lit(">")),
        plus=lambda a, s: F.concat(a, F.lit("("), s, F.lit(")")),
        mult=lambda x, y: F.concat(x, y),
        agg=None,
    ),
    wrap=WrapForm(
        leaf=lambda a: F.concat(F.lit("<"), a, F.lit(">")),
        open=lambda a: F.concat(a, F.lit("(")),
        close=lambda a: F.lit(")"),
    ),
)


def _trees(seed, n_trees, nodes):
    rng = random.Random(seed)
    trees = {}
    for t in range(n_trees):
        tokens = random_tokens(rng, rng.randint(1, nodes), rng.choice([0.1, 0.5, 0.9, 0.99]), lambda r: str(r.randint(0, 9)), rng.randint(1, 3))
        trees[t] = random_cuts(rng, tokens, rng.randint(0, len(tokens) // 2)) if len(tokens) > 1 else [tokens]
    return trees


def _want(trees):
    return {t: strict_fold([x for c in chunks for x in c], words) for t, chunks in trees.items()}


def test_random_trees_under_random_cuts(spark):
    trees = _trees(7, 120, 40)
    chunks = spark.createDataFrame(chunk_rows(trees), CHUNKS)
    assert answers(ordered.fold_ordered_chunks(chunks, words)) == _want(trees)


def test_small_ranges(spark, monkeypatch):
    """Groups and windows of a few rows, so that every step crosses its bounds."""
    monkeypatch.setattr(levels, "BITS", 2)
    trees = _trees(8, 15, 60)
    chunks = spark.createDataFrame(chunk_rows(trees), CHUNKS)
    assert answers(ordered.fold_ordered_chunks(chunks, words)) == _want(trees)


def _path(depth):
    rng = random.Random(3)
    tokens = []
    for _ in range(depth):  # siblings before and after the next node, so that order shows at every level
        tokens += [str(rng.randint(0, 9)), str(rng.randint(0, 9)), None]
    for _ in range(depth):
        tokens += [str(rng.randint(0, 9)), None, None]
    return [tokens[i : i + 50] for i in range(0, len(tokens), 50)]


def test_a_deep_tree_is_not_merged_in_one_task(spark, monkeypatch):
    trees = {1: _path(1500), 2: [["5", None]], 3: _path(20)}
    chunks = spark.createDataFrame(chunk_rows(trees), CHUNKS)
    merged = []

    def watched(partials, algebra):
        merged.append(partials.agg(F.max(F.size("cs") + F.size("abs"))).first()[0])
        assert {r[0] for r in partials.select("tree_id").distinct().collect()} == {2, 3}
        return real(partials, algebra)

    real = fold.fold_partials
    monkeypatch.setattr(fold, "fold_partials", watched)
    monkeypatch.setattr(levels, "BITS", 5)
    assert answers(fold.fold_tree(chunks, words, entry_limit=200)) == _want(trees)
    assert merged[0] <= 200

    # no group of the tall tree holds more than a block of chunks on one level, or a range of factors
    partials = chunk_partial(chunks.filter("tree_id = 1"), words)
    entries = ordered.partial_entries(partials, chunk_depth(chunk_shape(partials)), words)
    blocks = entries.groupBy("level", F.shiftright("c", BLOCK_BITS)).count().agg(F.max("count")).first()[0]
    factors = ordered.bracket_factors(entries, words)
    ranges = factors.groupBy(F.shiftright("pos", 5)).count().agg(F.max("count")).first()[0]
    assert blocks <= 3 << BLOCK_BITS and ranges <= 32
    assert factors.select("pos").distinct().count() == factors.count() == 6000


def test_an_algebra_without_a_form_for_tall_trees(spark):
    trees = {1: _path(60), 2: _path(3)}
    chunks = spark.createDataFrame(chunk_rows(trees), CHUNKS)
    plain = replace(words, wrap=None)
    assert answers(fold.fold_tree(chunks, plain, entry_limit=16)) == _want(trees)
    with pytest.raises(ValueError, match="wrap form"):
        fold.fold_tree(chunks, plain, entry_limit=16, merge_limit=64)
    with pytest.raises(ValueError, match="wrap form"):
        ordered.fold_ordered_chunks(chunks, plain)


@pytest.mark.parametrize("lines", [["1", "/ /"], ["1 2", "/"], ["1 /", "/"]])
def test_unbalanced_input_raises(spark, lines):
    chunks = spark.createDataFrame([(1, i, line.split(" ")) for i, line in enumerate(lines)], CHUNKS)
    with pytest.raises(Exception, match="unbalanced"):
        ordered.fold_ordered_chunks(chunks, words).collect()


def test_ranges_of_a_key_come_together(spark):
    """Three rounds of ranges are two shuffles, and the factors stay in order."""
    rows = [(k, p) for k in range(3) for p in range(0, 1 << 26, 1 << 20)]
    table = spark.createDataFrame(rows, "k bigint, pos bigint").selectExpr("k", "pos", "named_struct('h', (pos >> 20) + k, 'w', 31L) as v")
    out = levels.ordered_reduce(table, ["k"], order_hash, 1 << 26)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    want = {}
    for k, p in rows:
        h, w = want.get(k, (0, 1))
        want[k] = ((h * 31 + (p >> 20) + k) % 1_000_003, w * 31 % 1_000_003)
    assert {r.k: (r.v.h, r.v.w) for r in out.collect()} == want
