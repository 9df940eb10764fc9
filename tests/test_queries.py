"""The registered queries: same keys as the SQL, and equal results for a part of them (all of them run on
the larger tables outside the tests)."""

import glob
import os

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as contract
from boughs.catalog.oracles import all_oracles
from boughs.catalog.queries import all_queries

NAMES = [
    "fold_chunks_max_path_sum",
    "fold_chunks_sum_product",
    "fold_chunks_path_automaton",
    "fold_rounds_max_path_sum",
    "fold_pairs_sum_product",
    "fold_levels_star_max_path_sum",
    "fold_forest",
    "tree_algebra_custom_chunks",
    "match_brackets",
    "chunk_partial",
    "merge_partials",
    "compose_pairs",
    "pair_tree",
    "mating_pairs_path",
    "sum_zip",
    "zip_check",
    "gen_chunks",
    "gen_branching",
    "serialize_depth_split",
    "read_depth_text",
    "read_numbered_text",
    "read_token_ranges",
    "result_codec",
    "tree_from_edges",
    "rank_edges_path",
    "rank_edges_walk",
    "pair_pieces",
    "fold_ordered_path",
    "fold_levels_path_tall",
    "fold_tree_tall",
    "fold_pairs_sum_product_contract",
    "match_brackets_segments",
    "gen_trees",
    "gen_trees_matrix",
]


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(contract.queries()) and set(all_oracles()) <= set(contract.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    cursor = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str(dict(sorted(zip(columns, r)))) for r in cursor.fetchall())
    got = sorted(str(dict(sorted(r.asDict().items()))) for r in df.collect())
    assert got == want


def test_entry(spark):
    values = {r.tree_id: r.value for r in contract.entry(spark).collect()}
    assert values == {0: 79, 1: 94, 2: 95, 3: 44, 4: 37}
