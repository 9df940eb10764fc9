"""Every fold strategy against fixture values and against the definition under random cuts."""

import random
from dataclasses import replace

import pytest
from conftest import CHUNKS, FIXTURES, answers, chunk_rows, random_cuts, random_tokens, strict_fold
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boughs.functions import matrix
from boughs.functions.algebra import (
    ColumnForm,
    TreeAlgebra,
    WrapForm,
    max_path_sum,
    path_automaton,
    sum_product,
    value_sum,
)
from boughs.operators.edges import number_edges
from boughs.operators.partials import chunk_partial, chunk_shape
from boughs.operators.shape import match_brackets
from boughs.plans.chunks import fold_chunks
from boughs.plans.contraction import fold_rounds
from boughs.plans.fold import fold_tree
from boughs.plans.levels import fold_levels, fold_ordered, fold_star
from boughs.plans.pairs import chunk_depth, fold_pairs, mating_pairs, pair_tree
from boughs.session import materialize, shared_dir
from boughs.sources.text import tokenize

spell = TreeAlgebra(
    name="spell",
    value_type=T.StringType(),
    result_type=T.StringType(),
    hom=lambda a: a,
    plus=lambda a, s: f"{a}({s})",
    mult=lambda x, y: x + y,
    parse=str,
    parse_col=lambda t: t,
    format_col=lambda v: v,
    column=ColumnForm(
        hom=lambda a: a,
        plus=lambda a, s: F.concat(a, F.lit("("), s, F.lit(")")),
        mult=lambda x, y: F.concat(x, y),
        agg=None,
    ),
)


@pytest.fixture(scope="module")
def fixture_nodes(spark, fixture_chunks):
    return materialize(match_brackets(tokenize(fixture_chunks, max_path_sum)), "nodes")


@pytest.mark.parametrize("algebra", [max_path_sum, sum_product], ids=lambda a: a.name)
@pytest.mark.parametrize("plan", [fold_chunks, fold_pairs, fold_tree, fold_levels, fold_rounds], ids=lambda f: f.__name__)
def test_fixture_values(fixture_chunks, fixture_nodes, algebra, plan):
    source = fixture_nodes if plan in (fold_levels, fold_rounds) else fixture_chunks
    want = {t: v[1 if algebra is max_path_sum else 2] for t, v in FIXTURES.items()}
    assert answers(plan(source, algebra)) == want


def test_every_plan_has_one_overflow_rule(spark):
    """A chain of nodes valued 0 with a leaf 2 each; a zero at the bottom clears what the factors above would be."""
    n = 60
    chain = [0] * n + [0, None] + [x for _ in range(n) for x in (2, None, None)]
    flat = {0: chain, 1: [t if t != 0 else 5 for t in chain], 2: [3, None], 3: [1 << 60, 0, None, None], 4: [1, 1 << 60, None, 0, None, None]}
    chunks = materialize(spark.createDataFrame(chunk_rows({t: random_cuts(random.Random(t), x, 6) for t, x in flat.items()}), CHUNKS), "over")
    nodes = materialize(match_brackets(tokenize(chunks, sum_product)), "over")
    plans = {
        "chunks": (fold_chunks, chunks, {}), "pairs": (fold_pairs, chunks, {}), "pairs, rounds": (fold_pairs, chunks, {"small": 2}),
        "tree": (fold_tree, chunks, {"entry_limit": 4}), "levels": (fold_levels, nodes, {}), "rounds": (fold_rounds, nodes, {}),
        "rounds, small": (fold_rounds, nodes, {"small": 16}),
    }
    for name, (plan, source, options) in plans.items():
        good = source.filter("tree_id in (0, 2, 4)")
        assert answers(plan(good, sum_product, **options)) == {0: 0, 2: 3, 4: 1}, name
        for bad in {"chunks": (1, 3), "tree": (1,), "levels": (3,), "rounds, small": (1,)}.get(name, ()):
            with pytest.raises(Exception, match="exact range"):
                plan(source.filter(f"tree_id = {bad}"), sum_product, **options).collect()


def test_missing_parents_cycles_and_deeper_nodes_raise(spark):
    kind = "tree_id bigint, node_id bigint, parent_id bigint, depth int, value bigint"
    orphan = spark.createDataFrame([(0, 0, None, 0, 1), (0, 1, 0, 1, 1), (0, 2, 9, 1, 1)], kind)
    cycle = spark.createDataFrame([(0, 0, None, 0, 1), (0, 1, 2, 1, 1), (0, 2, 1, 1, 1)], kind)
    for small in (1, 100):
        for rows, match in ((orphan, "parent not found"), (cycle, "cycle")):
            with pytest.raises(Exception, match=match):
                fold_rounds(rows, max_path_sum, small=small).collect()
    with pytest.raises(ValueError, match="parent not found"):
        fold_levels(orphan, max_path_sum)
    deep = spark.createDataFrame([(0, 0, None, 0, 1), (0, 1, 0, 1, 1), (0, 2, 1, 2, 1)], kind)
    for height in (0, 1):
        with pytest.raises(Exception, match="deeper than height"):
            fold_levels(deep, max_path_sum, height=height).collect()
        with pytest.raises(ValueError, match="deeper than height"):
            number_edges(deep, height=height)
    assert answers(fold_levels(deep, max_path_sum, height=2)) == {0: 3}


def test_star_levels(spark):
    top = spark.createDataFrame([(1, None, 10), (2, None, 20)], "k bigint, p bigint, v bigint")
    middle = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (3, 9, 7)], "k bigint, p bigint, v bigint")
    leaves = spark.createDataFrame([(None, 1, 4), (None, 1, 4), (None, 1, 3), (None, 3, 9), (None, 8, 1)], "k bigint, p bigint, v bigint")
    assert answers(fold_star([leaves, middle, top], value_sum)) == {1: 32, 2: 20}
    assert answers(fold_star([leaves, middle, top], max_path_sum)) == {1: 19, 2: 20}
    assert answers(fold_star([leaves, middle, top], sum_product)) == {1: 10 + (5 + 48) * 6, 2: 20}
    assert answers(fold_star([leaves, middle], max_path_sum, forest=True)) == {1: 9, 9: 16}
    with pytest.raises(ValueError, match="order"):
        fold_star([leaves, middle, top], spell)


def test_small_fan_in_and_forced_contraction(fixture_chunks, fixture_nodes):
    want = {t: v[1] for t, v in FIXTURES.items()}
    assert answers(fold_chunks(fixture_chunks, max_path_sum, fan_in=2)) == want
    assert answers(fold_rounds(fixture_nodes, max_path_sum, small=2)) == want
    assert answers(fold_pairs(fixture_chunks, max_path_sum, small=1)) == want
    assert answers(fold_tree(fixture_chunks, max_path_sum, entry_limit=5)) == want


@pytest.mark.parametrize(
    "algebra,value",
    [
        (max_path_sum, lambda r: r.randint(-9, 9)),
        (sum_product, lambda r: r.randint(-1, 1)),
        (path_automaton, lambda r: [r.getrandbits(10) & r.getrandbits(10) for _ in range(10)]),
        (value_sum, lambda r: r.randint(-9, 9)),
    ],
    ids=["max_path_sum", "sum_product", "path_automaton", "value_sum"],
)
def test_random_trees_under_random_cuts(spark, algebra, value):
    rng = random.Random(algebra.name)
    flat = {
        t: random_tokens(rng, rng.randint(1, 40), (0.0, 0.4, 0.6, 1.0)[t % 4], value, 1 + (t % 5 == 0) * 2)
        for t in range(80)
    }
    trees = {t: random_cuts(rng, tokens, rng.randint(0, 8)) for t, tokens in flat.items()}
    text = (lambda m: str(matrix.int_of_masks(m))) if algebra is path_automaton else str
    chunks = materialize(spark.createDataFrame(chunk_rows(trees, text), CHUNKS), "random")
    want = {t: strict_fold(tokens, algebra) for t, tokens in flat.items()}
    assert answers(fold_chunks(chunks, algebra, fan_in=3)) == want
    assert answers(fold_pairs(chunks, algebra)) == want
    nodes = materialize(match_brackets(tokenize(chunks, algebra), segment_bits=4), "random")
    assert answers(fold_rounds(nodes, algebra)) == want
    assert answers(fold_rounds(nodes, algebra, small=8)) == want
    if algebra is not sum_product:
        assert answers(fold_levels(nodes.filter("tree_id % 4 < 3"), algebra)) == {
            t: v for t, v in want.items() if t % 4 < 3
        }


def test_non_commutative_algebra(spark):
    rng = random.Random(11)
    flat = {t: random_tokens(rng, rng.randint(1, 30), 0.4, lambda r: r.choice("abcd")) for t in range(30)}
    trees = {t: random_cuts(rng, tokens, 4) for t, tokens in flat.items()}
    chunks = spark.createDataFrame(chunk_rows(trees), CHUNKS)
    want = {t: strict_fold(tokens, spell) for t, tokens in flat.items()}
    assert answers(fold_chunks(chunks, spell, fan_in=2)) == want
    nodes = match_brackets(tokenize(chunks, spell))
    assert answers(fold_levels(nodes, spell)) == want
    with pytest.raises(ValueError, match="commutative"):
        fold_pairs(chunks, spell)


def test_unbalanced_input_raises(spark):
    for tokens in (["1", "/", "/"], ["1", "2", "/"]):
        chunks = spark.createDataFrame([(0, 0, tokens[:2]), (0, 1, tokens[2:])], CHUNKS)
        for plan in (fold_chunks, fold_pairs):
            with pytest.raises(Exception, match="unbalanced"):
                plan(chunks, max_path_sum).collect()


def test_partials_of_sample_2(fixture_chunks):
    rows = chunk_partial(fixture_chunks.filter("tree_id = 2"), max_path_sum).orderBy("chunk_id").collect()
    v = lambda xs: [x["v"] for x in xs]
    assert [v(r["cs"]) for r in rows] == [[None], [8, None], [None, 1, None, None], [None, -4, None]]
    assert [[(x["a"], x["v"]) for x in r["abs"]] for r in rows] == [
        [(3, 4), (-5, None), (6, None), (-2, None)],
        [(-1, 4)],
        [(5, None)],
        [],
    ]


def test_pairs_of_the_samples(fixture_chunks):
    shapes = chunk_shape(chunk_partial(fixture_chunks.filter("tree_id <= 2"), max_path_sum))
    depths = materialize(chunk_depth(shapes), "depths")
    got = {(r.tree_id, r.chunk_id): (r.n_cs, r.n_abs, r.depth) for r in depths.collect()}
    assert [got[1, c] for c in range(4)] == [(1, 1, 0), (1, 1, 1), (1, 1, 2), (4, 0, 0)]
    assert [got[2, c] for c in range(4)] == [(1, 4, 0), (2, 1, 3), (4, 1, 1), (3, 0, 0)]
    pairs = mating_pairs(depths)
    got = {(r.tree_id, r.off_l, r.off_r): (r.du, r.dl) for r in pairs.collect()}
    assert got == {
        (1, 0, 1): (1, None), (1, 1, 2): (2, None), (1, 2, 3): (2, None), (1, 1, 3): (1, 2), (1, 0, 3): (0, 1),
        (2, 0, 1): (3, None), (2, 1, 2): (3, None), (2, 0, 2): (1, 3), (2, 2, 3): (1, None), (2, 0, 3): (0, 1),
    }
    parents = {
        (r.off_l, r.off_r): (r.parent_l, r.parent_r) for r in pair_tree(pairs).filter("tree_id = 2").collect()
    }
    assert parents == {(0, 3): (None, None), (2, 3): (0, 3), (0, 2): (0, 3), (1, 2): (0, 2), (0, 1): (0, 2)}


def test_pair_search_and_sum_contraction(spark):
    depths = spark.createDataFrame([(0, 0, 0), (0, 1, 3), (0, 2, 1), (0, 3, 0)], "tree_id bigint, chunk_id bigint, depth int")
    tree = pair_tree(mating_pairs(depths))
    values = {(0, 3): 1, (2, 3): 2, (0, 2): 3, (1, 2): 4, (0, 1): 5}
    rows = [
        (0, r.off_l * 10 + r.off_r, None if r.parent_l is None else r.parent_l * 10 + r.parent_r, values[r.off_l, r.off_r])
        for r in tree.collect()
    ]
    nodes = spark.createDataFrame(rows, "tree_id bigint, node_id bigint, parent_id bigint, value bigint")
    assert len(rows) == 5 and answers(fold_rounds(nodes, value_sum)) == {0: 15}
    assert answers(fold_rounds(nodes, value_sum, small=1)) == {0: 15}


def test_mating_pairs_brute_force(spark):
    rng = random.Random(2)
    rows, want = [], set()
    for t in range(40):
        n = rng.randint(1, 12)
        d = [0] + [rng.randint(0, 4) for _ in range(n)]
        rows += [(t, i, x) for i, x in enumerate(d)]
        for i in range(len(d)):
            for j in range(i + 1, len(d)):
                low = min(d[i + 1 : j], default=99)
                if low > max(d[i], d[j]):
                    want.add((t, i, j, max(d[i], d[j]), None if low == 99 else low))
    df = spark.createDataFrame(rows, "tree_id bigint, chunk_id bigint, depth int")
    assert {tuple(r) for r in mating_pairs(df).collect()} == want
    assert sorted(map(str, mating_pairs(df, block_bits=1).collect())) == sorted(map(str, mating_pairs(df).collect()))
    assert mating_pairs(df.filter("tree_id < 0")).count() == 0


def test_mating_pairs_of_deep_trees_and_sparse_chunks(spark):
    """Rows go with the chunks, not with the levels climbed; blocks of blocks, missing chunk numbers, one shared block."""
    rng = random.Random(3)
    shapes = {
        0: [1000 * i for i in range(20)] + [1000 * i + 7 for i in range(19, -1, -1)],
        1: [0] + [5000 - i for i in range(60)],
        2: [0] + [9] * 40 + [0],
        3: [rng.randint(0, 50) for _ in range(70)],
        4: [3],
    }
    rows, want = [], []
    for t, d in shapes.items():
        at = [i * (1 + t) + (40 if t == 3 and i > 30 else 0) for i in range(len(d))]
        rows += [(t, c, x) for c, x in zip(at, d)]
        for i in range(len(d)):
            low = 10**9
            for j in range(i + 1, len(d)):
                if low > max(d[i], d[j]):
                    want.append((t, at[i], at[j], max(d[i], d[j]), None if j == i + 1 else low))
                low = min(low, d[j])
    df = spark.createDataFrame(rows, "tree_id bigint, chunk_id bigint, depth int")
    got = [tuple(r) for r in mating_pairs(df, block_bits=2).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len(got) < 2 * len(rows)


def test_deep_path_and_wide_star(spark):
    n = 3000
    path = [1] * n + [None] * n
    star = [1] + [2, None] * n + [None]
    trees = {0: [path[i : i + 100] for i in range(0, 2 * n, 100)], 1: [star[i : i + 100] for i in range(0, 2 * n + 2, 100)]}
    chunks = materialize(spark.createDataFrame(chunk_rows(trees), CHUNKS), "deep")
    want = {0: n, 1: 3}
    assert answers(fold_tree(chunks, max_path_sum, entry_limit=1000)) == want
    assert answers(fold_pairs(chunks, max_path_sum, small=20)) == want
    assert answers(fold_chunks(chunks, max_path_sum, fan_in=4)) == want


def test_ordered_fold_at_any_height(spark):
    """Not commutative: the text of a tree, on paths longer than a range and on random trees."""
    wrapped = replace(
        spell,
        wrap=WrapForm(leaf=lambda a: a, open=lambda a: F.concat(a, F.lit("(")), close=lambda a: F.lit(")")),
    )
    rng = random.Random(12)
    flat = {t: random_tokens(rng, rng.randint(1, 40), 0.5, lambda r: r.choice("abcd"), 1 + t % 2) for t in range(12)}
    n = 5000
    flat[99] = [rng.choice("abcd") for _ in range(n)] + [None] * n
    trees = {t: [x[i : i + 500] for i in range(0, len(x), 500)] for t, x in flat.items()}
    chunks = spark.createDataFrame(chunk_rows(trees), CHUNKS)
    nodes = match_brackets(tokenize(chunks, spell))
    assert answers(fold_ordered(nodes, wrapped)) == {t: strict_fold(x, spell) for t, x in flat.items()}
    with pytest.raises(ValueError, match="wrap"):
        fold_ordered(nodes, spell)


def test_tables_go_to_the_warehouse_without_a_checkpoint_dir(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.sql.warehouse.dir": "hdfs://store/warehouse/"}.get(key, default)

    class Context:
        applicationId, master = "app-1", "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    assert shared_dir(Session()) == "hdfs://store/warehouse/boughs-scratch/app-1"
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
