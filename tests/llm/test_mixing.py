from collections import defaultdict

from llm import brute
import pytest
from pyspark.sql import functions as F

from boughs.llm import mixing


def _sized(docs):
    return docs.select("doc_id", F.array("source").alias("sources"), mixing.text_size(F.col("text")).alias("size"))


def test_sizes(docs):
    got = docs.select("text", mixing.text_size(F.col("text")).alias("size")).collect()
    assert all(r["size"] == len(brute.words(r.text)) for r in got)


def test_targets_stop_at_three_times_the_source():
    sizes = {"a": 10, "b": 1000, None: 5, "c": 0}
    t = mixing.source_targets(sizes, 1015)
    assert t["a"] == 30 and t["c"] == 0 and t[None] == 15 and t["b"] == 970
    assert mixing.source_targets({}, 0) == {}
    assert mixing.source_targets({"a": 0}, 0) == {"a": 0}
    # code-point order: capital letters first
    assert mixing.source_targets({"a": 600, "B": 600}, 1200) == {"B": 400, "a": 800}


def test_mix_of_documents(docs):
    out = mixing.mix_sources(_sized(docs))
    first, again = (sorted(map(tuple, out.select("doc_id", "size", "taken").collect()), key=repr) for _ in range(2))
    assert first == again and len(first) == docs.count()
    taken, target = defaultdict(int), {}
    for r in out.collect():
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.sources[0]] += r.taken
        target[r.sources[0]] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_overlapping_sources_repeat_as_little_as_possible(spark):
    # "b" can only be filled from documents that "a" also has; "a" must then use its own ones
    rows = [(i, ["a"], 10) for i in range(30)] + [(100 + i, ["a", "b"], 10) for i in range(10)]
    rows += [(200, None, 7), (201, [], 7), (202, ["a", "a"], 0), (None, ["b", "a"], 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, sources array<string>, size bigint")
    out = mixing.mix_sources(docs, weights=(1, 1))
    got = out.collect()
    assert len(got) == len(rows)
    assert sum(r.taken for r in got) == 410
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert all(not r.taken for r in got if not r.sources)


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_cheapest(seed):
    import random

    rng = random.Random(seed)
    names = "abc"
    patterns = {}
    while len(patterns) < 4:
        p = tuple(sorted(rng.sample(names, rng.randint(1, 3))))
        patterns[p] = rng.randint(1, 3)
    quotas = {s: rng.randint(0, 4) for s in names}
    flow = mixing.route(patterns, quotas, 3)

    def cost(used):
        return sum(sum(i // patterns[p] for i in range(n)) for p, n in used.items())

    best = {}  # all ways, word by word, as (filled, cost)

    def search(order, used):
        if not order:
            best[0] = min(best.get(0, (0, 10**9)), (0, cost(used)))
            return
        for p in patterns:
            if order[0] in p and used[p] < 3 * patterns[p]:
                search(order[1:], used | {p: used[p] + 1})

    order = [s for s, q in quotas.items() for _ in range(q)]
    if len(order) <= 8:
        search(order, dict.fromkeys(patterns, 0))
        used = {p: sum(f.values()) for p, f in flow.items()}
        if best:
            assert {s: sum(f.get(s, 0) for f in flow.values()) for s in names} == quotas
            assert cost(used) == best[0][1]


def test_flow_does_not_depend_on_the_order_of_patterns():
    import random

    rng = random.Random(3)
    patterns = {("a", "b"): 10, ("a", "c"): 10, ("b", "c"): 10, ("a",): 4, ("c", None): 7}
    quotas = {"a": 12, "b": 13, "c": 20, None: 3}
    want = mixing.route(patterns, quotas)
    for _ in range(20):
        turned = list(patterns.items())
        rng.shuffle(turned)
        assert mixing.route(dict(turned), quotas) == want


def test_flow_over_many_patterns_of_one_source():
    """A pattern is looked at once per use, not once per step: 200,000 patterns take seconds."""
    import time

    patterns = {("a", f"{i:06d}"): 5 for i in range(1000)} | {("a",): 10**6} | {(f"s{i}",): 3 for i in range(200_000)}
    quotas = {"a": 1_500_000} | {f"s{i}": 7 for i in range(200_000)}
    start = time.perf_counter()
    flow = mixing.route(patterns, quotas)
    assert time.perf_counter() - start < 60
    assert sum(f.get("a", 0) for f in flow.values()) == 1_500_000
    assert all(flow[(f"s{i}",)] == {f"s{i}": 7} for i in range(0, 200_000, 997))


def test_empty_table_and_too_many_patterns(docs, nothing):
    assert mixing.mix_sources(_sized(nothing)).collect() == []
    with pytest.raises(ValueError, match="patterns"):
        mixing.mix_sources(_sized(docs), max_patterns=2)
