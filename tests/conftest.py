import os
import random
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("boughs-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


# ---- brute force: the definition of a fold, on token lists ----


def trees_of(tokens):
    """Token list (None closes) -> list of (value, children)."""
    roots, stack = [], []
    for t in tokens:
        if t is not None:
            node = (t, [])
            (stack[-1][1] if stack else roots).append(node)
            stack.append(node)
        else:
            stack.pop()
    assert not stack
    return roots


def strict_fold(tokens, algebra):
    """Evaluate without recursion: values are combined as soon as a node closes."""
    stack, top = [], [None, False]

    def give(x):
        slot = stack[-1] if stack else top
        slot[-2] = algebra.mult(slot[-2], x) if slot[-1] else x
        slot[-1] = True

    for t in tokens:
        if t is not None:
            stack.append([t, None, False])
        else:
            a, s, has = stack.pop()
            give(algebra.plus(a, s) if has else algebra.hom(a))
    return top[0]


def random_tokens(rng: random.Random, n: int, deepness: float, value, roots: int = 1):
    out, depth, opened, made = [], 0, 0, 0
    while opened < n or depth:
        last_root = made == roots
        can_open = opened < n
        must_open = depth == 0 or (depth == 1 and can_open and last_root)
        if can_open and (must_open or rng.random() < deepness):
            made += depth == 0
            out.append(value(rng))
            depth, opened = depth + 1, opened + 1
        else:
            out.append(None)
            depth -= 1
    return out


def random_cuts(rng: random.Random, tokens, n_cuts):
    at = sorted(rng.sample(range(1, len(tokens)), min(n_cuts, len(tokens) - 1)))
    return [tokens[i:j] for i, j in zip([0, *at], [*at, len(tokens)])]


def chunk_rows(trees, text=str):
    return [
        (tree_id, chunk_id, ["/" if t is None else text(t) for t in chunk])
        for tree_id, chunks in trees.items()
        for chunk_id, chunk in enumerate(chunks)
    ]


CHUNKS = "tree_id bigint, chunk_id bigint, tokens array<string>"
TOKENS = "tree_id bigint, pos bigint, value bigint"


def answers(df):
    return {r["tree_id"]: r["value"] for r in df.collect()}


SAMPLE_1 = ["1 1 1 / 1 / 1 / / 1 /", "1 1 / 1 / 1 1 1 / / /", "1 1 1 1 / 1 / / / 1 /", "/ / 1 / 1 / /"]
SAMPLE_2 = ["3 4 / -5 6 -2", "/ 8 / -1 4 /", "/ / 1 / / 5", "/ 2 -6 / / /"]
FIXTURES = {
    # tree: lines, max_path_sum, sum_product
    1: (SAMPLE_1, 6, 27),
    2: (SAMPLE_2, 12, 3763),
    3: (["1 2 / 3 4 / 5 / / 6 / /"], 9, 277),
    4: (["3 6 2 1 / / 4 / / 5 / -1 3 / / /"], 13, 183),
    5: (["7 6 2 0 / 1 / / 4 / / 9 / 5 3 / / /"], 17, 1015),
    6: (["2 3", "/ /"], 5, 5),
    7: (["2 1 / /"], 3, 3),
    8: (["2 3", "/ 4 /", "/"], 6, 14),
    9: (["2 3 / /"], 5, 5),
}


@pytest.fixture(scope="session")
def fixture_chunks(spark):
    rows = [(t, i, line.split(" ")) for t, (lines, _, _) in FIXTURES.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, CHUNKS)
