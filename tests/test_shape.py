"""Shape operators, text, zip, edges and generators on small fixtures and random streams."""

import random

import pytest
from conftest import CHUNKS, SAMPLE_2, TOKENS, random_tokens
from pyspark.sql import functions as F

from boughs.functions.algebra import max_path_sum, path_automaton
from boughs.operators import edges, scan, shape, skew, zip as zips
from boughs.session import materialize, new_path
from boughs.sources import generate, text


def token_rows(trees):
    return [(t, i, x) for t, tokens in trees.items() for i, x in enumerate(tokens)]


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(1, i, line.split(" ")) for i, line in enumerate(SAMPLE_2)]
    return materialize(text.tokenize(spark.createDataFrame(rows, CHUNKS), max_path_sum), "sample")


NODES_2 = [
    # value, open, close, parent, depth
    (3, 0, 23, None, 0), (4, 1, 2, 0, 1), (-5, 3, 16, 0, 1), (6, 4, 13, 3, 2), (-2, 5, 6, 4, 3), (8, 7, 8, 4, 3),
    (-1, 9, 12, 4, 3), (4, 10, 11, 9, 4), (1, 14, 15, 3, 2), (5, 17, 18, 0, 1), (2, 19, 22, 0, 1), (-6, 20, 21, 19, 2),
]


@pytest.mark.parametrize("bits", [1, 3, 14])
def test_sample_nodes(sample, bits):
    rows = shape.match_brackets(sample, bits).orderBy("node_id").collect()
    assert [(r.value, r.node_id, r.close_pos, r.parent_id, r.depth) for r in rows] == NODES_2
    assert [r.node_id for r in rows if r.is_leaf] == [1, 5, 7, 10, 14, 17, 20]


def brute_nodes(tokens):
    stack, out = [], {}
    for i, t in enumerate(tokens):
        if t is not None:
            out[i] = [None, stack[-1] if stack else None, len(stack)]
            stack.append(i)
        else:
            out[stack.pop()][0] = i
    return {(i, *v) for i, v in out.items()}


def test_random_streams_in_small_segments(spark):
    rng = random.Random(4)
    trees = {t: random_tokens(rng, rng.randint(1, 60), (0.1, 0.5, 1.0)[t % 3], lambda r: 1, 1 + t % 3) for t in range(25)}
    tokens = materialize(spark.createDataFrame(token_rows(trees), TOKENS), "streams")
    for bits in (2, 5):
        got = {}
        for r in shape.match_brackets(tokens, bits).collect():
            got.setdefault(r.tree_id, set()).add((r.node_id, r.close_pos, r.parent_id, r.depth))
        assert got == {t: brute_nodes(x) for t, x in trees.items()}
    back = shape.serialize_tree(shape.match_brackets(tokens)).select("tree_id", "pos", "value", "depth")
    assert sorted(map(str, back.collect())) == sorted(map(str, shape.token_depth(tokens, 3).collect()))


def test_scan_blocks(spark):
    df = spark.range(0, 100).select((F.col("id") % 3).alias("k"), F.col("id"), ((F.col("id") * 7) % 11).alias("x"))
    got = scan.exclusive_scan(df, ["k"], "id", {"s": ("x", "sum"), "m": ("x", "min"), "l": ("x", "last")}, block_bits=3)
    for r in got.collect():
        before = [(i * 7) % 11 for i in range(r.id % 3, r.id, 3)]
        assert (r.s, r.m, r.l) == (sum(before), min(before, default=None), before[-1] if before else None)


def test_validation(spark):
    df = spark.createDataFrame(token_rows({0: [1, None, None], 1: [1, 2, None], 2: [1, None], 3: [None, 1]}), TOKENS)
    for bits in (1, 14):
        got = {r.tree_id: (r.extra_closes, r.unclosed_opens, r.valid) for r in shape.validate_tokens(df, bits).collect()}
        assert got == {0: (1, 0, False), 1: (0, 1, False), 2: (0, 0, True), 3: (1, 1, False)}


def test_small_operators(sample):
    nodes = materialize(shape.match_brackets(sample), "nodes")
    assert shape.tree_size(sample).first().n_nodes == 12
    assert shape.tree_max_depth(nodes).first().max_depth == 4
    assert shape.tree_root_value(sample).first().value == 3
    assert [r.value for r in shape.preorder(sample).collect()] == [n[0] for n in NODES_2]
    assert {r.node_id: r.size for r in shape.subtree_size(nodes).collect()}[3] == 7
    assert shape.leaf_filter(nodes).count() == 7 and shape.root_filter(nodes).count() == 1
    assert shape.tree_edges(nodes).count() == 11
    doubled = shape.tree_map(sample, lambda v: v * 2)
    assert doubled.agg(F.sum("value")).first()[0] == 38 and doubled.filter("value is null").count() == 12


def test_text_round_trip(spark, sample):
    lines = text.serialize_depth(sample, 4).orderBy("line").collect()
    assert lines[0].text == "0\t0 3 1 4 1 / 1 -5 2 6 3 -2" and len(lines) == 4
    assert len(text.serialize_depth(sample, 5).collect()) == 6  # 24 tokens cut every 4
    path = new_path(spark, "text")
    chunks = text.split_chunks(sample, 5)
    text.write_tree_text(chunks, path)
    back = text.read_tree_text(spark, f"{path}/tree_id=1").select("chunk_id", "tokens").orderBy("chunk_id")
    assert back.collect() == chunks.select("chunk_id", "tokens").orderBy("chunk_id").collect()


def test_text_order_over_splits_and_files(spark, tmp_path):
    lines = [f"{i} /" + " 7 /" * (i % 5) for i in range(400)]
    for f, part in (("b", lines[200:]), ("a", lines[:200])):
        (tmp_path / f"{f}.txt").write_text("\n\n".join(part) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        one = text.read_tree_text(spark, str(tmp_path)).orderBy("chunk_id").collect()
        two = text.read_tree_text(spark, str(tmp_path), per_file=True).orderBy("tree_id", "chunk_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [" ".join(r.tokens) for r in one] == lines and [r.chunk_id for r in one] == list(range(400))
    assert [(r.tree_id, r.chunk_id) for r in two] == [(i // 200, i % 200) for i in range(400)]


def test_result_codec(spark):
    df = spark.createDataFrame([(None,), (5,)], "v bigint").withColumn("t", text.format_result(F.col("v")))
    assert [(r.t, r.w) for r in df.withColumn("w", text.parse_result(F.col("t"))).collect()] == [("_", None), ("5", 5)]


def test_matrix_text_in_the_jvm(spark):
    rng = random.Random(8)
    words = [str(rng.getrandbits(100)) for _ in range(50)]
    df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("m", path_automaton.parse_col(F.col("w")))
    for r in df.withColumn("b", path_automaton.format_col(F.col("m"))).collect():
        assert r.b == r.w and list(r.m) == path_automaton.parse(r.w)


def test_zip(spark, sample):
    tens = sample.withColumn("value", F.col("value") * 10)
    got = zips.sum_zip(sample, tens).filter("value is not null").orderBy("pos").collect()
    assert [r.value for r in got] == [n[0] * 11 for n in NODES_2]
    checked = zips.zip_check(sample, tens.filter("pos < 22")).first()
    assert (checked.n_positions, checked.n_mismatches, checked.first_mismatch) == (24, 2, 22)
    turned = tens.withColumn("value", F.when(F.col("pos") != 5, F.col("value")))
    with pytest.raises(Exception, match="open against close"):
        zips.sum_zip(sample, turned).collect()


def test_edges(spark, sample, monkeypatch):
    nodes = materialize(shape.match_brackets(sample), "nodes")
    table = nodes.select("tree_id", "node_id", "parent_id", "value")
    for hot in (1 << 20, 1):
        monkeypatch.setattr(skew.spread_join, "__defaults__", (hot,))
        got = edges.number_edges(edges.tree_from_edges(table)).orderBy("node_id").collect()
        want = nodes.orderBy("node_id").collect()
        assert [(r.node_id, r.open_pos, r.close_pos, r.depth, r.is_leaf) for r in got] == [
            (r.node_id, r.node_id, r.close_pos, r.depth, r.is_leaf) for r in want
        ]
    with pytest.raises(ValueError, match="root not found"):
        edges.tree_from_edges(table.filter("parent_id is not null"))
    with pytest.raises(ValueError, match="parent not found"):
        edges.tree_from_edges(table.filter("node_id != 4"))
    ring = spark.createDataFrame([(0, 0, None), (0, 1, 2), (0, 2, 1)], "tree_id bigint, node_id bigint, parent_id bigint")
    with pytest.raises(ValueError, match="cycle"):
        edges.tree_from_edges(ring)


@pytest.mark.parametrize("deepness", [0.0, 0.5, 1.0])
def test_generator(spark, deepness):
    specs = spark.createDataFrame([(0, 1), (1, 2), (2, 20), (3, 4000)], "tree_id bigint, n_nodes bigint")
    tokens = materialize(generate.gen_trees(specs, deepness, seed=5), "gen")
    assert all(r.valid for r in shape.validate_tokens(tokens).collect())
    depths = shape.token_depth(tokens).groupBy("tree_id").agg(
        F.count("value").alias("n"), F.max("depth").alias("d"), F.count_if(F.col("depth") == 0).alias("roots")
    )
    got = {r.tree_id: (r.n, r.d, r.roots) for r in depths.collect()}
    assert {t: v[0] for t, v in got.items()} == {0: 1, 1: 2, 2: 20, 3: 4000} and all(v[2] == 2 for v in got.values())
    if deepness != 0.5:
        assert got[3][1] == (3999 if deepness else 1)
    again = generate.gen_trees(specs, deepness, seed=5)
    assert again.exceptAll(tokens).isEmpty()
    sizes = generate.gen_chunks(specs.filter("tree_id = 2"), 4, deepness).orderBy("chunk_id").collect()
    assert [len(r.tokens) for r in sizes] == [11, 11, 11, 7]


def test_generator_arguments(spark):
    specs = spark.createDataFrame([(0, 0)], "tree_id bigint, n_nodes bigint")
    with pytest.raises(ValueError):
        generate.gen_trees(specs, 1.5)
    with pytest.raises(ValueError):
        generate.gen_chunks(specs, 0)
    with pytest.raises(Exception, match="positive"):
        generate.gen_trees(specs).collect()


def brute_branching(leaves, branches, frac_up, depth):
    items, ids, parent = list(range(leaves)), leaves, {}
    while depth > 2 and items and len(items) >= branches:
        kept = int(len(items) * frac_up)
        rest = items[kept:]
        size = max(len(rest) // branches, 1)
        runs = [rest[i : i + size] for i in range(0, len(rest), size)][::-1]
        items = items[:kept]
        for run in runs:
            parent.update({x: (ids, i) for i, x in enumerate(run)})
            items.append(ids)
            ids += 1
        depth -= 1
    parent.update({x: (ids, i) for i, x in enumerate(items)})
    parent[ids] = (None, 0)
    return parent


@pytest.mark.parametrize("args", [(20, 3, 0.2, 5), (7, 8, 0.5, 4), (0, 2, 0.5, 5), (50, 2, 0.0, 9), (33, 4, 0.9, 6)])
def test_branching(spark, args):
    rows = generate.gen_branching(spark, *args).collect()
    assert {r.node_id: (r.parent_id, r.pos_in_parent) for r in rows} == brute_branching(*args)


def _depth_file(tmp_path, *lines):
    path = tmp_path / f"depth-{abs(hash(lines))}.txt"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_depth_text_round_trip(spark, tmp_path):
    rng = random.Random(8)
    flat = {t: random_tokens(rng, rng.randint(1, 60), 0.5, lambda r: r.randint(-9, 9), 1 + t % 3) for t in range(12)}
    rows = [(t, i, x) for t, tokens in flat.items() for i, x in enumerate(tokens)]
    tokens = spark.createDataFrame(rows, "tree_id bigint, pos bigint, value bigint")
    path = str(tmp_path / "depth")
    text.write_depth_text(text.serialize_depth(tokens, 5), path)
    got = text.read_depth_text(spark, path, max_path_sum)
    want = {tuple(r) for r in shape.token_depth(tokens).collect()}
    assert {tuple(r) for r in got.select("tree_id", "pos", "value", "depth").collect()} == want
    one = text.read_depth_text(spark, _depth_file(tmp_path, "1\t1 / 0 /", "", "0\t0 5 1 -2"), max_path_sum)
    assert sorted(map(tuple, one.collect())) == [(0, 0, 5, 0), (0, 1, -2, 1), (0, 2, None, 1), (0, 3, None, 0)]


@pytest.mark.parametrize(
    "line", ["0\t0 1 0", "0\t0 1 2 2 2 / 0 /", "0\t0 1 0 / 0 /", "0\t0 1 1 2 1 /", "0\t0 1 1 /", "0\tx 1 0 /", "0\t1 1 1 /"]
)
def test_wrong_depth_text_raises(spark, tmp_path, line):
    with pytest.raises(Exception):  # noqa: B017
        text.read_depth_text(spark, _depth_file(tmp_path, line), max_path_sum).collect()


def test_numbered_text_needs_no_order(spark, tmp_path):
    rows = [(t, c, [str(t), str(c), "/"][: 1 + c % 3]) for t in range(5) for c in range(7)]
    chunks = spark.createDataFrame(rows, "tree_id bigint, chunk_id bigint, tokens array<string>").repartition(4)
    path = str(tmp_path / "numbered")
    text.write_numbered_text(chunks, path)
    assert sorted(map(tuple, text.read_numbered_text(spark, path).collect())) == rows


def test_files_are_numbered_in_path_order(spark, tmp_path):
    for i in (3, 1, 2):
        (tmp_path / f"f{i}.in").write_text("".join(f"{i} {j} /\n" for j in range(i)))
    got = text.read_tree_text(spark, str(tmp_path)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.tokens[:2]) for r in got] == list(enumerate([["1", "0"], ["2", "0"], ["2", "1"], ["3", "0"], ["3", "1"], ["3", "2"]]))
    got = text.read_tree_text(spark, str(tmp_path), per_file=True).collect()
    assert sorted((r.tree_id, r.chunk_id) for r in got) == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]


def test_indexed_tokens_stay_in_place(spark, sample, monkeypatch):
    """No exchange holds the tokens while the starts fit a broadcast; with more chunks the join gives the same rows."""
    chunks = materialize(text.split_chunks(sample.select("tree_id", "pos", "value"), 5), "five")
    want = sorted(tuple(r) for r in chunks.select("tree_id", F.posexplode(F.flatten(F.array("tokens"))), "chunk_id").select(
        "tree_id", F.col("chunk_id") * 5 + F.col("pos"), "col").collect())
    for bound, moved in ((1 << 20, False), (1, True)):
        monkeypatch.setattr(shape, "HELD_STARTS", bound)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = shape.index_tokens(chunks)
        rows = sorted(tuple(r) for r in got.collect())
        plan = got._jdf.queryExecution().sparkPlan().toString()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert rows == want
        assert ("SortMergeJoin" in plan or "ShuffledHashJoin" in plan) == moved


def test_shared_folder_on_a_cluster(monkeypatch):
    """A cluster without a shared folder is refused, since its executors would write to their own disks."""
    from types import SimpleNamespace

    from boughs import session

    def fake(master, warehouse):
        conf = {"spark.sql.warehouse.dir": warehouse}
        context = SimpleNamespace(master=master, applicationId=f"app-{master}-{warehouse}", getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=context)

    monkeypatch.setattr(session.atexit, "register", lambda *a, **k: None)
    for _ in range(2):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(fake("spark://host:7077", "file:/tmp/w"))
    assert session.shared_dir(fake("local[8]", "file:/tmp/w")).startswith("file:/tmp/w/")
    assert session.shared_dir(fake("spark://host:7077", "hdfs://name/w")).startswith("hdfs://name/w/")
