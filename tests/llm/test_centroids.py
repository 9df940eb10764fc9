import random

import numpy as np
import pytest

from boughs.llm import centroids
from llm.brute import clusters


def rows(seed=1, n=120, dims=4):
    rng = random.Random(seed)
    out = [(i, [rng.gauss(0, 0.3) for _ in range(dims)]) for i in range(n)]
    same = [(1000 + i, out[0][1]) for i in range(30)]  # one vector often, and repeated rows
    bad = [(-1, None), (-2, []), (-3, [1.0] * 3), (-4, [1.0, None, 1.0, 1.0]), (-5, [float("nan")] * 4), (-6, [float("inf")] * 4)]
    return out + same + [out[3], out[3], (None, out[5][1])] + bad


def found(spark, data, **options):
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id bigint, embedding array<float>, cluster int, n int")
    out = centroids.cluster_vectors(table.repartition(3), ["vec_id"], dims=4, k=5, **options)
    return sorted((tuple(r) for r in out.drop("centroid").collect()), key=repr), {tuple(r.centroid) for r in out.collect()}


@pytest.mark.parametrize("width, limit", [(1, 1 << 18), (2, 20), (3, 0)])
def test_against_plain_rounds(spark, width, limit):
    data = rows()
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in data]
    want, final = clusters(floats, dims=4, k=5)
    got, used = found(spark, data, width=width, limit=limit)
    assert got == sorted(want, key=repr)
    assert used <= set(final)


def test_ties_go_to_the_smaller_number(spark):
    got, _ = found(spark, [(i, [0.0] * 4) for i in range(9)])
    assert {r[1] for r in got} == {0} and {r[2] for r in got} == {0}


def test_few_and_no_vectors(spark):
    assert len(found(spark, [(1, [0.5] * 4), (2, [0.1] * 4)])[0]) == 2
    assert found(spark, [(1, [0.5] * 3), (None, None)])[0] == []


def test_a_component_too_large_raises(spark):
    with pytest.raises(Exception, match="too large"):
        found(spark, [(1, [1e30] * 4)])


def test_codes_are_lossless():
    rng = np.random.default_rng(3)
    x = rng.integers(-5, 5, (300, 3))
    block = centroids.Block.of(0, np.unique(x[:200], axis=0))
    codes = block.codes(x)
    known = {tuple(r) for r in x[:200]}
    for row, code in zip(x, codes):
        assert tuple(row) == tuple(block.subs[code]) if tuple(row) in known else code == -1
