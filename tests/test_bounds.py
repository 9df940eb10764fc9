"""Steps that must stay bounded whatever the size of the input; results do not depend on the bounds."""

import random

import pytest
from conftest import CHUNKS, answers, chunk_rows, random_cuts, random_tokens, strict_fold

from boughs.catalog.queries import order_hash
from boughs.functions.algebra import max_path_sum, path_automaton
from boughs.operators import partials as partial_ops
from boughs.plans import ordered as ordered_ops
from boughs.plans import pairs as pair_ops
from boughs.plans.chunks import fold_chunks
from boughs.plans.pairs import fold_pairs


def _trees(algebra, value):
    rng = random.Random(5)
    return {t: random_tokens(rng, 300, 0.55, value) for t in range(4)}, rng


@pytest.mark.parametrize("algebra", [max_path_sum, path_automaton], ids=lambda a: a.name)
def test_steps_of_chunks_are_bounded(spark, monkeypatch, algebra):
    limit, seen = 64, spark.sparkContext.accumulator(0)
    monkeypatch.setattr(partial_ops, "STEP_ENTRIES", limit)
    fold = partial_ops.fold_events

    def watched(events, *args):
        if len(events.kind) > 4 * limit:
            seen.add(1)
        return fold(events, *args)

    monkeypatch.setattr(partial_ops, "fold_events", watched)
    text = str if algebra is max_path_sum else lambda t: str(t % (1 << 100))
    value = (lambda r: r.randint(-9, 9)) if algebra is max_path_sum else (lambda r: r.getrandbits(100))
    trees, rng = _trees(algebra, value)
    rows = chunk_rows({t: random_cuts(rng, x, 60) for t, x in trees.items()}, text)
    chunks = spark.createDataFrame(rows, CHUNKS).coalesce(1)
    typed = {t: [None if v is None else algebra.parse(text(v)) for v in x] for t, x in trees.items()}
    expected = {t: strict_fold(x, algebra) for t, x in typed.items()}
    assert answers(fold_chunks(chunks, algebra, 4)) == expected
    assert answers(fold_pairs(chunks, algebra, 8)) == expected
    assert seen.value == 0


@pytest.mark.parametrize("held", [1 << 20, 0], ids=["held", "shuffled"])
def test_entries_are_cut_by_rows(spark, monkeypatch, held):
    """Entries of tall trees compress well, so neither their writers nor their readers may be cut by bytes."""
    monkeypatch.setattr(pair_ops, "HELD_STARTS", held)
    monkeypatch.setattr(pair_ops, "_PART_CHUNKS", 4)
    for ops in (ordered_ops, pair_ops):
        monkeypatch.setattr(ops, "ENTRY_ROWS", 32)
    written, tables = pair_ops.materialize, {}

    def watched(df, label, *args, **kwargs):
        tables.setdefault(label, []).append((df, written(df, label, *args, **kwargs)))
        return tables[label][-1][1]

    for ops in (ordered_ops, pair_ops):
        monkeypatch.setattr(ops, "materialize", watched)
    rng = random.Random(8)
    trees = {t: random_tokens(rng, 200, 0.9, lambda r: r.randint(-9, 9)) for t in range(3)}
    chunks = spark.createDataFrame(chunk_rows({t: random_cuts(rng, x, 20) for t, x in trees.items()}), CHUNKS).coalesce(1)
    got = ordered_ops.fold_ordered_chunks(chunks, order_hash)
    assert {t: v.asDict() for t, v in answers(got).items()} == {t: strict_fold(x, order_hash) for t, x in trees.items()}
    assert answers(fold_pairs(chunks, max_path_sum)) == {t: strict_fold(x, max_path_sum) for t, x in trees.items()}
    for plan, table in tables["entries"]:
        rows, files = table.count(), len(table.inputFiles())
        assert rows > 64 and files >= rows / 32
        if not held:
            assert plan.rdd.getNumPartitions() >= 63 / 4
