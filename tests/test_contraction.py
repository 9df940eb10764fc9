"""The numpy finish of the contraction: parents, levels by pointer jumping, and both ways to fold."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import answers, random_tokens, strict_fold
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from boughs.functions.algebra import max_path_sum, path_automaton, sum_product, value_sum
from boughs.functions.grouped import with_null_lists, without_null_lists
from boughs.plans import contraction, levels
from boughs.plans.contraction import fold_rounds, levels_by_jumps, parent_rows
from boughs.plans.pieces import contract_table

NODES = "tree_id bigint, node_id bigint, parent_id bigint, value bigint"


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 200), st.integers(0, 10**6), st.floats(0, 1))
def test_levels(n, seed, tall):
    rng = random.Random(seed)
    parent = [-1] + [i - 1 if rng.random() < tall else rng.randrange(-1, i) for i in range(1, n)]
    want = []
    for p in parent:
        want.append(0 if p < 0 else want[p] + 1)
    shuffled = list(range(n))
    rng.shuffle(shuffled)
    at = {old: new for new, old in enumerate(shuffled)}
    rows = np.array([-1 if parent[i] < 0 else at[parent[i]] for i in shuffled])
    assert levels_by_jumps(rows).tolist() == [want[i] for i in shuffled]


def test_cycles_raise():
    with pytest.raises(ValueError, match="cycle"):
        levels_by_jumps(np.array([-1, 2, 3, 1, 0]))


def test_parents_of_several_trees():
    tree, ids = np.array([5, 5, 9, 9]), np.array([7, -1, 7, 3])
    assert parent_rows(tree, ids, pa.chunked_array([pa.array([None, 7, 3, None])])).tolist() == [-1, 0, 3, -1]
    with pytest.raises(ValueError, match="parent"):
        parent_rows(tree, ids, pa.chunked_array([pa.array([None, 3, None, None])]))


def _nodes(tree, tokens):
    rows, stack = [], []
    for pos, t in enumerate(tokens):
        if t is None:
            stack.pop()
        else:
            rows.append((tree, pos, stack[-1] if stack else None, t))
            stack.append(pos)
    return rows


@pytest.mark.parametrize("algebra", [max_path_sum, sum_product, value_sum], ids=lambda a: a.name)
@pytest.mark.parametrize("small", [contraction.SMALL, 8])
def test_random_trees(spark, algebra, small):
    """Large values, zeros and tall trees, with and without rounds before the finish."""
    rng = random.Random(small)
    value = lambda r: r.choice([0, 1, -1, 2, 3, -2, 9] if algebra is sum_product else [0, 5, -7, 10**9])
    trees = {t: random_tokens(rng, rng.randint(1, 120), rng.choice([0.05, 0.5, 0.97]), value, 1 + t % 2) for t in range(25)}
    want = {t: strict_fold(x, algebra) for t, x in trees.items()}
    fine = {t: v for t, v in want.items() if v != -(1 << 63)}
    nodes = spark.createDataFrame([r for t, x in trees.items() if t in fine for r in _nodes(t, x)], NODES)
    assert len(fine) > 10 and answers(fold_rounds(nodes.repartition(3), algebra, small=small)) == fine


def _piece_table(rows, kids, algebra):
    """Rows ``(tree, node, parent, value)`` as a whole piece of ``contract_pieces``."""
    kind = to_arrow_type(algebra.result_type)
    out = [
        {"tree_id": t, "id": i, "parent": p, "k": None, "p": None, "wrapped": False, "a": v, "s": None, "has": False, "n": 0, "kids": None}
        for t, i, p, v in rows
    ]
    blank = {"parent": None, "k": None, "p": None, "wrapped": None, "a": None, "s": None, "has": None, "n": None}
    out += [{"tree_id": t, "id": i, **blank, "kids": n} for (t, i), n in kids.items()]
    types = [pa.int64()] * 3 + [kind, to_arrow_type(algebra.affine.p_type), pa.bool_(), kind, kind, pa.bool_(), pa.int64(), pa.int64()]
    names = ["tree_id", "id", "parent", "k", "p", "wrapped", "a", "s", "has", "n", "kids"]
    return pa.Table.from_pylist(out, pa.schema(list(zip(names, types)))).sort_by([("tree_id", "ascending"), ("id", "ascending")])


_VALUES = {
    "max_path_sum": lambda r: r.choice([0, 5, -7, 10**9]),
    "value_sum": lambda r: r.choice([0, 5, -7, 10**9]),
    "sum_product": lambda r: r.choice([0, 1, -1, 2, 3, -2, 9]),
    "path_automaton": lambda r: [r.getrandbits(10) & r.getrandbits(10) for _ in range(10)],
}
_ALL = [max_path_sum, value_sum, sum_product, path_automaton]


@pytest.mark.parametrize("algebra", _ALL, ids=lambda a: a.name)
def test_a_piece_keeps_what_has_neighbours_elsewhere(algebra):
    """A path cut into two pieces leaves a node of each; a whole tree leaves its root."""
    rng = random.Random(3)
    path = [(1, i, i - 1 if i else None, _VALUES[algebra.name](rng)) for i in range(2000)]
    kids = {(1, i): 1 for i in range(1999)}
    for lo, hi in ((0, 1000), (1000, 2000)):
        own = {k: n for k, n in kids.items() if lo <= k[1] < hi}
        left = contract_table(_piece_table(path[lo:hi], own, algebra), algebra.batch)
        # contexts of sum_product are not composed in numpy, so its chains stay; a finished subtree goes in any case
        assert left.num_rows == (1000 if algebra is sum_product and lo == 0 else 1)
    whole = contract_table(_piece_table(path, kids, algebra), algebra.batch)
    assert whole.num_rows == 1 and whole.column("n").to_pylist() == [0]


@pytest.mark.parametrize("numbers", ["positions", "shuffled"])
@pytest.mark.parametrize("algebra", _ALL, ids=lambda a: a.name)
def test_pieces(spark, algebra, numbers):
    """Pieces far smaller than the trees, then rounds, then the finish; numbers that follow the tree, or any."""
    rng = random.Random(11)
    heights = [0.05, 0.5, 0.9, 0.999]
    trees = {t: random_tokens(rng, rng.randint(60, 400), heights[t % 4], _VALUES[algebra.name], 1 + t % 3) for t in range(12)}
    want = {t: strict_fold(x, algebra) for t, x in trees.items()}
    fine = {t: v for t, v in want.items() if v != -(1 << 63)}
    rows = []
    for t in fine:
        nodes = _nodes(t, trees[t])
        ids = [r[1] for r in nodes]
        other = dict(zip(ids, rng.sample(range(-(10**12), 10**12), len(ids)) if numbers == "shuffled" else ids))
        rows += [(t, other[i], other.get(p), v) for _, i, p, v in nodes]
    schema = NODES if algebra is not path_automaton else NODES.replace("value bigint", "value array<int>")
    nodes = spark.createDataFrame(rows, schema).repartition(3)
    assert len(fine) > 5 and answers(fold_rounds(nodes, algebra, small=20, piece=100)) == fine


def test_pieces_with_nulls(spark):
    """A NULL value counts as zero, also where a tall tree would have raised in the rounds or in the finish."""
    rng = random.Random(5)
    rows = [(1, i, rng.randrange(max(0, i - 3), i) if i else None, rng.choice([None, 3, -4, 8])) for i in range(600)]
    rows += [(2, i, i - 1 if i else None, None if i % 5 == 2 else i % 9) for i in range(600)]
    nodes = spark.createDataFrame(rows, NODES).repartition(3)
    for algebra in (max_path_sum, value_sum):
        want = answers(fold_rounds(nodes.na.fill(0, ["value"]), algebra))
        assert answers(fold_rounds(nodes, algebra, small=20, piece=100)) == want


def test_pieces_with_repeated_numbers(spark):
    """Nodes that are there twice, or have no number, go through the rounds as before."""
    rows = [(3, i, (i - 1) // 2 if i else None, i % 7) for i in range(600)]
    nodes = spark.createDataFrame([*rows, (3, 400, 199, 1000), (3, None, 5, 2000), (3, 30, 200, 50)], NODES).repartition(3)
    for algebra in (max_path_sum, value_sum):
        want = answers(fold_rounds(nodes, algebra, small=20))
        assert answers(fold_rounds(nodes, algebra, small=20, piece=100)) == want


def test_null_lists_on_their_way(spark):
    table = pa.table({"x": pa.array([[1], None, [2, 3]], pa.list_(pa.int32())), "y": [1, None, 3]})
    rows = spark.createDataFrame([([1], 1), (None, None), ([2, 3], 3)], "x array<int>, y int")
    sent = without_null_lists(rows).toArrow()
    assert sent.column("x").null_count == 0 and with_null_lists(sent).to_pylist() == table.to_pylist()


def test_cycle_in_pieces(spark):
    """A cycle that shrinks to a node which is its own parent still raises."""
    rows = [(1, i, i - 1 if i else None, 1) for i in range(300)] + [(1, 300 + i, 300 + (i + 1) % 90, 1) for i in range(90)]
    nodes = spark.createDataFrame(rows, NODES)
    for small in (20, 250):
        with pytest.raises(Exception, match="cycle"):
            fold_rounds(nodes, value_sum, small=small, piece=50).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_composed_contexts_in_numpy(seed):
    """Forming and composing contexts in numpy agrees with applying them one by one."""
    rng = random.Random(seed)
    for algebra in (max_path_sum, value_sum, path_automaton):
        form, value = algebra.batch, _VALUES[algebra.name]
        nodes = [(value(rng), value(rng), rng.random() < 0.5) for _ in range(3)]
        x = want = value(rng)
        for a, s, has in reversed(nodes):
            want = algebra.plus(a, algebra.mult(s, want) if has else want)
        parts = [form.of_node(np.array([a]), np.array([s]), np.array([has])) for a, s, has in nodes]
        left = form.compose(*form.compose(*parts[0], *parts[1]), *parts[2])
        right = form.compose(*parts[0], *form.compose(*parts[1], *parts[2]))
        for k, p in (left, right):
            arrays = form.context_arrays(k, p, np.ones(1, bool))
            assert form.through(*form.contexts(*arrays), np.array([x])).tolist() == [want]
            assert algebra.affine.apply_value(arrays[0][0].as_py(), arrays[1][0].as_py(), x) == want


LEVELS = "tree_id int, node_id bigint, parent_id bigint, depth int, value bigint"


@pytest.mark.parametrize("algebra", _ALL, ids=lambda a: a.name)
def test_levels_of_raked_pieces(spark, monkeypatch, algebra):
    """Levels get only what pieces leave, and give the same."""
    rng = random.Random(7)
    trees = {t: random_tokens(rng, 600, 0.4, _VALUES[algebra.name], 1 + t % 2) for t in range(4)}
    want = {t: strict_fold(x, algebra) for t, x in trees.items()}
    fine = {t: v for t, v in want.items() if v != -(1 << 63)}
    rows = []
    for t in fine:
        depth = {None: -1}
        for _, i, p, v in _nodes(t, trees[t]):
            depth[i] = depth[p] + 1
            rows.append((t, i, p, depth[i], v))
    left = []
    by_depth = levels._by_depth
    monkeypatch.setattr(levels, "_by_depth", lambda nodes: (left.append(nodes.count()), by_depth(nodes))[1])
    monkeypatch.setattr(levels, "TALL", 1000)
    schema = LEVELS if algebra is not path_automaton else LEVELS.replace("value bigint", "value array<int>")
    out = levels.fold_levels(spark.createDataFrame(rows, schema).repartition(3), algebra, piece=400)
    assert fine and answers(out) == fine and out.schema["tree_id"].dataType.simpleString() == "int"
    assert left[0] < len(rows) / 2


def test_levels_of_raked_pieces_leave_out_what_they_did(spark):
    """NULL values, repeated and missing numbers, and depths that do not follow the parents."""
    rows = [(1, i, (i - 1) // 3 if i else None, 0, i % 11) for i in range(800)]
    depth = [0]
    for i in range(1, 800):
        depth.append(depth[(i - 1) // 3] + 1)
    rows = [(t, i, p, depth[i] + (i == 500), None if i % 97 == 5 else v) for t, i, p, _, v in rows]
    rows += [(1, 300, 99, 6, 900), (1, 90, 29, depth[90], 7), (1, None, 20, 4, 5000), (None, 3, None, 0, 4)]
    rows += [(1, 2000, 700, None, 10**6)]
    nodes = spark.createDataFrame(rows, LEVELS).repartition(3)
    for algebra in (max_path_sum, value_sum):
        want = answers(levels.fold_levels(nodes, algebra))
        assert answers(levels.fold_levels(nodes, algebra, piece=100)) == want
    orphans = [(1, 5000, 4000, 3, 1), (None, 5, 3, 1, 1), (1, 5000, 799 + 10**9, 3, 1)]
    for orphan in orphans:
        with pytest.raises(ValueError, match="parent not found"):
            levels.fold_levels(nodes.unionByName(spark.createDataFrame([orphan], LEVELS)), max_path_sum, piece=100)


def test_tall_trees_are_prepared_once(spark, monkeypatch):
    """Levels that hand a tall tree to the contraction neither sort it by depth nor check its parents twice."""
    calls = []
    check = contraction.check_parents
    for module in (contraction, levels):
        monkeypatch.setattr(module, "check_parents", lambda nodes: (calls.append(1), check(nodes)))
    monkeypatch.setattr(levels, "_by_depth", lambda nodes: pytest.fail("sorted by depth"))
    rows = [(1, i, i - 1 if i else None, i, 2) for i in range(60)]
    nodes = spark.createDataFrame(rows, "tree_id bigint, node_id bigint, parent_id bigint, depth int, value bigint")
    assert answers(levels.fold_levels(nodes, value_sum)) == {1: 120} and len(calls) == 1
    with pytest.raises(ValueError, match="parent"):
        levels.fold_levels(nodes.filter("node_id <> 7"), value_sum)


def test_contexts_in_numpy():
    """The numpy form of each context agrees with the scalar one."""
    rng = random.Random(4)
    for _ in range(200):
        x = rng.choice([0, 1, -3, 10**6, -(10**9)])
        lo, hi = sorted(rng.sample(range(-50, 50), 2))
        p = {"lo": lo, "hi": hi, "p": rng.randint(-9, 9), "any": rng.random() < 0.2}
        form, affine, k = sum_product.batch, sum_product.affine, rng.randint(-9, 9)
        got = form.apply(pa.array([k]), pa.array([p]), np.array([float(x)]))
        assert form.scalars(got)[0] == affine.apply_value(k, p, x)
        k = rng.choice([None, 4, -(10**9)])
        got = max_path_sum.batch.apply(pa.array([k], pa.int64()), pa.array([7]), np.array([x]))
        assert got[0] == max_path_sum.affine.apply_value(k, 7, x)
    m = lambda: [rng.getrandbits(10) for _ in range(10)]
    for _ in range(20):
        k, p, x = m(), m(), m()
        form, kind = path_automaton.batch, pa.list_(pa.int32())
        got = form.apply(pa.array([k], kind), pa.array([p], kind), np.array([x], np.int32))
        assert got[0].tolist() == list(path_automaton.affine.apply_value(k, p, x))
