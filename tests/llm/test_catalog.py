"""Every registered corpus query over whole tables, against its SQL in DuckDB."""

import glob
import os

from llm import brute
import duckdb
import pytest

from boughs.llm.catalog import llm_queries
from boughs.llm.oracles import llm_oracles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_queries():
    assert [n.split("_")[0] for n in llm_queries()] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_sql(spark, tables, name):
    out = llm_queries()[name](spark, SF)
    columns = sorted(out.columns)
    found = tables.execute(llm_oracles()[name])
    order = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)
    assert sorted(map(tuple, out.select(*columns).collect()), key=repr) == want


def _documents(tables):
    return tables.execute("SELECT doc_id, text FROM documents").fetchall()


def test_fingerprints(spark, tables):
    out = llm_queries()["op1_simhash_pigeonring"](spark, SF).select("doc_id", "fingerprint", "component_id")
    want = brute.groups([(i, brute.fingerprint(t)) for i, t in _documents(tables)])
    assert sorted(map(tuple, out.collect())) == sorted((i, f"{fp:016x}", c) for i, fp, c in want)


def test_base_rules(spark, tables):
    out = llm_queries()["op7_quality_rules"](spark, SF)
    got = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = {i: brute.base_quality(t) for i, t in _documents(tables)}
    rows = got.collect()
    assert len(rows) == len(want)
    assert all(tuple(r)[1:7] == want[r.doc_id] and not (r.kept and r.base_failed) for r in rows)
