"""List ranking of bracket lists against token positions."""

import random

import numpy as np
import pytest
from conftest import random_tokens

from boughs.operators import tour
from boughs.operators.edges import number_edges, tree_from_edges
from boughs.session import materialize

KIND = "tree_id bigint, node_id bigint, parent_id bigint"


def numbered(tokens, rng, ids=None):
    """Edges with sparse ids that keep the order of siblings, and (id, open, close, depth) of each node."""
    opens = [i for i, t in enumerate(tokens) if t is not None]
    step = dict(zip(opens, sorted(rng.sample(range(-5000, 5000), len(opens))))) if ids is None else dict(zip(opens, ids))
    stack, edges, want = [], [], set()
    for i, t in enumerate(tokens):
        if t is not None:
            edges.append((step[i], step[stack[-1]] if stack else None))
            stack.append(i)
        else:
            at = stack.pop()
            want.add((step[at], at, i, len(stack)))
    return edges, want


def ranks(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.tree_id, set()).add((r.node_id, r.open_pos, r.close_pos, r.depth))
    return got


@pytest.mark.parametrize("small", [30, tour.SMALL])
def test_random_trees(spark, small):
    rng = random.Random(7)
    rows, want = [], {}
    for t in range(24):
        tokens = random_tokens(rng, rng.randint(1, 90), (0.1, 0.5, 1.0)[t % 3], lambda r: 1, 1 + t % 3)
        edges, want[t] = numbered(tokens, rng)
        rows += [(t, *e) for e in edges]
    rng.shuffle(rows)
    assert ranks(tour.rank_edges(spark.createDataFrame(rows, KIND), small)) == want


def test_extreme_ids_and_columns(spark):
    """The largest ids, a node number 0 below the roots, and columns of the caller that stay."""
    low, high = -(2**63), 2**63 - 1
    rows = [(2**62, low, None, "a", 5), (2**62, 0, low, "b", 6), (2**62, high, low, None, 7), (2**62, -1, 0, "d", 8)]
    table = spark.createDataFrame(rows, KIND + ", name string, w int")
    for small in (2, 100):
        out = tour.rank_edges(table, small)
        assert set(out.columns) == {"tree_id", "node_id", "parent_id", "name", "w", "open_pos", "close_pos", "depth"}
        got = {r.node_id: (r.open_pos, r.close_pos, r.depth, r.name, r.w) for r in out.collect()}
        assert got == {low: (0, 7, 0, "a", 5), 0: (1, 4, 1, "b", 6), -1: (2, 3, 2, "d", 8), high: (5, 6, 1, None, 7)}


def test_faults(spark):
    ring = [(0, 0, None), (0, 1, 2), (0, 2, 1)]
    far = [(0, 0, None), (0, 1, 9)]
    for small in (3, 100):
        for rows, match in ((ring, "cycle"), (far, "parent not found"), ([(0, 1, 1)], "cycle"), ([(0, 0, None), (0, 1, 0), (0, 1, 0)], "cycle|twice")):
            with pytest.raises(Exception, match=match):
                tour.rank_edges(spark.createDataFrame(rows, KIND), small).collect()
    assert tour.rank_edges(spark.createDataFrame([], KIND)).collect() == []


def test_wide_family_is_spread(spark):
    """One parent of all nodes: its family lies in several ranges, and no window holds it whole."""
    n = 5000
    star = spark.range(n).selectExpr("0L as tree_id", "id as node_id", "if(id = 0, null, 0L) as parent_id")
    rows = tour._ranged(star)
    assert rows.filter("not top").groupBy("part").count().agg({"count": "max"}).first()[0] < n
    got = tour.rank_edges(star, 2000).collect()
    assert {(r.node_id, r.open_pos, r.close_pos) for r in got} == {(0, 0, 2 * n - 1)} | {(i, 2 * i - 1, 2 * i) for i in range(1, n)}


def test_rounds_are_logarithmic(spark, monkeypatch):
    """A path of 4,000 nodes takes a few rounds of one table each, not one per level."""
    n, made = 4000, []
    splice = tour._splice
    monkeypatch.setattr(tour, "_splice", lambda state, i: made.append(i) or splice(state, i))
    path = spark.range(n).selectExpr("7L as tree_id", "id as node_id", "if(id = 0, null, id - 1) as parent_id")
    got = tour.rank_edges(path, 1000).collect()
    assert {(r.node_id, r.open_pos, r.close_pos, r.depth) for r in got} == {(i, i, 2 * n - 1 - i, i) for i in range(n)}
    assert 4 <= len(made) <= 14


def test_number_edges_takes_it_for_tall_trees(spark):
    n = 60
    path = spark.range(n).selectExpr("1L as tree_id", "id as node_id", "if(id = 0, null, id - 1) as parent_id")
    deep = materialize(tree_from_edges(path), "deep")
    got = number_edges(deep).collect()
    assert {(r.node_id, r.open_pos, r.close_pos, r.depth) for r in got} == {(i, i, 2 * n - 1 - i, i) for i in range(n)}
    with pytest.raises(ValueError, match="deeper than height"):
        number_edges(deep, height=n - 2)


def test_rank_lists():
    tree = np.array([3, 3, 3, 5])
    pos, depth = tour.rank_lists(tree, np.array([10, 4, 7, 20]), np.array([-1, 7, 10, -1]), np.array([1, 1, 2, 2]), np.array([0, 1, -1, 0]))
    assert pos.tolist() == [3, 0, 1, 0] and depth.tolist() == [0, 0, 1, 0]


def test_rounds_travel_packed_between_buckets(spark, monkeypatch):
    """Many buckets per round; elements of a round are a few rows of packed pieces, not a row each."""
    monkeypatch.setattr(tour, "BUCKET", 500)
    made, splice = [], tour._splice
    monkeypatch.setattr(tour, "_splice", lambda sent, i: made.append((sent.buckets, sent.table.count())) or splice(sent, i))
    n, rng = 3000, random.Random(5)
    ids = rng.sample(range(-(10**9), 10**9), n)
    rows = [(t, *e) for t in (3, 4) for e in zip(ids, [None, *ids[:-1]])] + [(5, 1, None), (5, 2, 1)]
    got = ranks(tour.rank_edges(spark.createDataFrame(rows, KIND), 40))
    path = {(v, i, 2 * n - 1 - i, i) for i, v in enumerate(ids)}
    assert got == {3: path, 4: path, 5: {(1, 0, 3, 0), (2, 1, 2, 1)}}
    assert made[0][0] == 25 and made[-1][0] < 4 and max(rows for _, rows in made) < n


def test_number_edges_derives_its_table_once(spark):
    """The depths, the bounds of the ranges and the ranges come from one run of the source."""
    read = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    n = 500
    edges = spark.range(n).selectExpr("0L as tree_id", "id as node_id", "if(id = 0, null, (id - 1) div 4) as parent_id", "cast((length(bin(3 * id + 1)) - 1) div 2 as int) as depth")
    got = number_edges(edges.mapInArrow(rows, edges.schema)).collect()
    assert read.value == n
    assert sorted(p for r in got for p in (r.open_pos, r.close_pos)) == list(range(2 * n))
