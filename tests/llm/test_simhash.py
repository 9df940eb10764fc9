import random

from llm import brute
from llm.conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from boughs.llm import simhash
from boughs.llm.components import components


def test_groups_of_documents(docs):
    rows = [(r.doc_id, brute.fingerprint(r.text)) for r in docs.collect()]
    want = sorted(((i, f"{fp:016x}", c) for i, fp, c in brute.groups(rows)), key=repr)
    got = simhash.simhash_groups(docs, ["doc_id"])
    assert rows_of(got, "doc_id", simhash.fingerprint_hex(), "component_id") == want


def test_empty_table(nothing):
    assert simhash.simhash_groups(nothing, ["doc_id"]).collect() == []
    assert simhash.drop_near_copies(nothing).collect() == []


def test_one_row_of_each_group_stays(docs):
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, brute.fingerprint(r.text)) for r in docs.collect()]
    want = sorted({c for _, _, c in brute.groups(rows)})
    assert sorted(r.doc_id for r in kept.collect()) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=6), st.integers(1, 6), st.integers(1, 4))
def test_a_link_shares_a_table_and_keeps_the_budgets(fp, flips, threshold, chain):
    other = fp ^ sum(1 << b for b in flips)
    found = False
    for keys, prefixes in simhash.chain_tables(threshold, chain):
        same_key = fp & keys == other & keys
        found |= same_key and all(((fp ^ other) & m).bit_count() <= n for n, m in enumerate(prefixes, 1))
    if len(flips) <= threshold:
        assert found


def test_links_of_clusters_across_blocks(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            near = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                near ^= 1 << b
            fps.add(near)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    table = spark.createDataFrame(rows, "fp bigint")
    want = {fp: c for _, fp, c in brute.groups([(i, fp) for i, fp in enumerate(sorted(fps))])}
    for block in (8, 2048):
        roots = {r.node: r.root for r in components(simhash.pigeonring_links(table, block=block)).collect()}
        groups, expected = {}, {}
        for (signed,) in rows:
            groups.setdefault(roots.get(signed, signed), set()).add(signed)
        for fp, c in want.items():
            expected.setdefault(c, set()).add(fp - (1 << 64) if fp >> 63 else fp)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 560)] + [(7, 7), (3, 2)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(101)} | {i: 500 for i in range(500, 560)}
