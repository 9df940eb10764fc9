"""Generated trees: values of whole batches, and tasks cut by the tokens they make."""

from boughs.sources import generate


def test_matrices_of_generated_trees(spark):
    """The numpy values are those of the expression, and token rows are cut into tasks before they are made."""
    specs = spark.createDataFrame([(3, 40_000), (1, 7), (9, 1)], "tree_id bigint, n_nodes bigint")
    got = generate.gen_trees(specs, 0.7, seed=11, matrices=True)
    plain = generate.gen_trees(specs, 0.7, seed=11)
    element = generate.matrix_element(plain["tree_id"], generate.F.lit(11), plain["pos"])
    want = plain.select("tree_id", "pos", generate.F.when(plain["value"].isNotNull(), element).alias("value"))
    assert got.count() == want.count() == 2 * 40_008
    assert got.exceptAll(want).isEmpty()


def test_generated_segments_are_spread(spark, monkeypatch):
    monkeypatch.setattr(generate, "_TASK_SEGMENTS", 2)
    made = []
    written = generate.materialize

    def watched(df, label, *args):
        made.append((label, df))
        return written(df, label, *args)

    monkeypatch.setattr(generate, "materialize", watched)
    specs = spark.createDataFrame([(0, 150_000)], "tree_id bigint, n_nodes bigint")
    assert generate.gen_trees(specs, 0.7, seed=2).count() == 300_000
    body = written(dict(made)["generated"], "again")
    assert len(body.inputFiles()) > 4
