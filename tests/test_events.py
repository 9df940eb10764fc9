"""The chunk helper against the definition, without Spark: random trees under random cuts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from conftest import random_cuts, random_tokens, strict_fold

from boughs.functions import matrix
from boughs.functions.algebra import (
    EXACT_LIMIT,
    OVERFLOW,
    TreeAlgebra,
    max_path_sum,
    path_automaton,
    sum_product,
    value_sum,
)
from boughs.functions.fold_events import CLOSE, OPEN, Events, fold_by_level, fold_by_stack
from boughs.operators.partials import _batch, _events_of_partials

TYPES = {
    "max_path_sum": (pa.int64(), pa.int64()),
    "sum_product": (pa.int64(), pa.int64()),
    "path_automaton": (pa.list_(pa.int32()), pa.list_(pa.int32())),
}
VALUE = {
    "max_path_sum": lambda r: r.randint(-9, 9),
    "sum_product": lambda r: r.randint(-1, 1),
    "path_automaton": lambda r: [r.getrandbits(10) & r.getrandbits(10) for _ in range(10)],
}


def events(algebra, chunks, scalar):
    flat = [t for c in chunks for t in c]
    kind = np.array([CLOSE if t is None else OPEN for t in flat], dtype=np.int8)
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in chunks])]).astype(np.int64)
    if scalar:
        return Events(kind, flat, offsets)
    zero = [0] * 10 if algebra is path_automaton else 0
    dtype = {"sum_product": np.float64, "path_automaton": np.int32}.get(algebra.name, np.int64)
    values = np.array([zero if t is None else t for t in flat], dtype=dtype)
    return Events(kind, values.reshape(len(flat), *([10] if algebra is path_automaton else [])), offsets)


def table(p):
    n = len(p.cs_offsets) - 1
    ids = pa.array([0] * n, pa.int64())
    return pa.Table.from_batches([_batch(ids, pa.array(range(n), pa.int64()), p)])


@pytest.mark.parametrize("algebra", [max_path_sum, sum_product, path_automaton], ids=lambda a: a.name)
@pytest.mark.parametrize("deepness", [0.0, 0.3, 0.6, 1.0])
def test_partials_and_merges(algebra, deepness):
    rng = random.Random(f"{algebra.name}{deepness}")
    a_type, v_type = TYPES[algebra.name]
    for _ in range(60):
        tokens = random_tokens(rng, rng.randint(1, 25), deepness, VALUE[algebra.name], rng.randint(1, 3))
        chunks = random_cuts(rng, tokens, rng.randint(0, 8))
        by_level = table(fold_by_level(events(algebra, chunks, False), algebra.batch))
        by_stack = table(fold_by_stack(events(algebra, chunks, True), algebra, a_type, v_type))
        assert by_level.to_pylist() == by_stack.to_pylist()
        # merge in two ways: all at once, and in two groups first (associativity)
        cut = rng.randint(0, len(chunks))
        halves = []
        for part in (by_level.slice(0, cut), by_level.slice(cut)):
            ev, counts = _events_of_partials(part.combine_chunks(), algebra)
            halves.append(fold_by_level(Events(ev.kind, ev.values, np.array([0, counts.sum()])), algebra.batch))
        for source in (by_level, pa.concat_tables([table(h) for h in halves])):
            ev, counts = _events_of_partials(source.combine_chunks(), algebra)
            whole = table(fold_by_level(Events(ev.kind, ev.values, np.array([0, counts.sum()])), algebra.batch))
            row = whole.to_pylist()[0]
            assert row["abs"] == [] and len(row["cs"]) == 1
            assert row["cs"][0]["v"] == strict_fold(tokens, algebra)


def test_order_is_kept_for_a_non_commutative_algebra():
    spell = TreeAlgebra("spell", None, None, hom=str, plus=lambda a, s: f"{a}({s})", mult=lambda x, y: x + y)
    rng = random.Random(5)
    for _ in range(40):
        tokens = random_tokens(rng, rng.randint(1, 20), 0.5, lambda r: r.choice("abc"))
        chunks = random_cuts(rng, tokens, rng.randint(0, 5))
        part = table(fold_by_stack(events(spell, chunks, True), spell, pa.string(), pa.string()))
        ev, counts = _events_of_partials(part, spell)
        whole = table(
            fold_by_stack(Events(ev.kind, ev.values, np.array([0, counts.sum()])), spell, pa.string(), pa.string())
        )
        assert whole.to_pylist()[0]["cs"][0]["v"] == strict_fold(tokens, spell)


def test_overflow():
    big = Events(np.array([1, 1, -1, -1], dtype=np.int8), np.array([2**63 - 1, 1, 0, 0]), np.array([0, 4]))
    for algebra in (max_path_sum, value_sum):
        with pytest.raises(OverflowError):
            fold_by_level(big, algebra.batch)
    wide = [1.0] + [2.0, 0.0] * 54 + [0.0]
    kind = np.array([1] + [1, -1] * 54 + [-1], dtype=np.int8)
    got = fold_by_level(Events(kind, np.array(wide), np.array([0, len(kind)])), sum_product.batch)
    assert got.cs_v.to_pylist() == [OVERFLOW]
    many = Events(np.array([1, -1] * 9, dtype=np.int8), np.array([2**60, 0] * 9), np.array([0, 18]))
    with pytest.raises(OverflowError):
        fold_by_level(many, value_sum.batch)


def _near_limit(r):
    """Values from everyday ones to those around the exact range."""
    kind = r.random()
    if kind < 0.3:
        return r.randint(-3, 3)
    if kind < 0.5:
        return r.choice([1, -1]) * 2 ** r.randint(20, 54)
    if kind < 0.6:
        return r.choice([EXACT_LIMIT, EXACT_LIMIT - 1, -EXACT_LIMIT, 1 - EXACT_LIMIT, 2**62, -(2**63), 2**63 - 1])
    return r.randint(-(2**27), 2**27)


def test_one_overflow_rule_in_scalar_and_batch_form():
    rng = random.Random(4)
    for _ in range(200):
        tokens = random_tokens(rng, rng.randint(1, 12), rng.random(), _near_limit)
        kind = np.array([CLOSE if t is None else OPEN for t in tokens], dtype=np.int8)
        texts = pa.array([None if t is None else str(t) for t in tokens], pa.string())
        ev = Events(kind, sum_product.batch.decode(texts), np.array([0, len(tokens)]))
        want = strict_fold(tokens, sum_product)
        assert fold_by_level(ev, sum_product.batch).cs_v.to_pylist() == [want]
        ev = Events(kind, sum_product.batch.scalars(ev.values), ev.offsets)
        assert fold_by_stack(ev, sum_product, pa.int64(), pa.int64()).cs_v.to_pylist() == [want]


@pytest.mark.parametrize(
    "algebra,value",
    [(max_path_sum, VALUE["max_path_sum"]), (sum_product, _near_limit), (path_automaton, VALUE["path_automaton"])],
    ids=lambda x: getattr(x, "name", ""),
)
def test_composed_contexts_equal_plain_evaluation(spark, algebra, value):
    """Chains of nodes with finished siblings, composed from either end, near all limits."""
    rng, rows = random.Random(3), []
    for i in range(600):
        nodes = [(value(rng), rng.choice([None, algebra.hom(value(rng)), algebra.hom(value(rng))])) for _ in range(rng.randint(1, 5))]
        if algebra is sum_product:
            nodes = [(a, rng.choice([s, s, s, 0, OVERFLOW])) for a, s in nodes]
        x = algebra.hom(value(rng))
        y = x
        for a, s in reversed(nodes):
            y = algebra.plus(a, y if s is None else algebra.mult(s, y))
        rows.append((i, nodes, x, y))
    a_type, v_type = algebra.value_type.simpleString(), algebra.result_type.simpleString()
    df = spark.createDataFrame(rows, f"i int, nodes array<struct<a:{a_type},s:{v_type}>>, x {v_type}, y {v_type}")
    form = algebra.affine

    def both(kp):
        return F.struct(kp[0].cast(algebra.result_type).alias("k"), kp[1].cast(form.p_type).alias("p"))

    df = df.withColumn("c", F.transform("nodes", lambda e: both(form.of_node(e["a"], e["s"])))).withColumn("r", F.reverse("c"))
    rest = [F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))) for c in ("c", "r")]
    down = F.aggregate(rest[0], F.get("c", F.lit(0)), lambda u, l: both(form.compose(u["k"], u["p"], l["k"], l["p"])))
    up = F.aggregate(rest[1], F.get("r", F.lit(0)), lambda l, u: both(form.compose(u["k"], u["p"], l["k"], l["p"])))
    df = df.withColumn("down", down).withColumn("up", up)
    got = df.select("y", "down", "x", *[form.apply(F.col(f"{c}.k"), F.col(f"{c}.p"), F.col("x")).alias(f"y_{c}") for c in ("down", "up")])
    for r in got.collect():
        plain = form.apply_value(r.down.k, r.down.p.asDict() if algebra is sum_product else r.down.p, r.x)
        assert r.y == r.y_down == r.y_up == plain


def test_matrix_text_round_trip():
    rng = random.Random(1)
    for _ in range(50):
        x = rng.getrandbits(100)
        assert matrix.int_of_masks(matrix.masks_of_int(x)) == x
