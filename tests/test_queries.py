"""Registered queries on the smallest tables against their oracle."""

import glob
import os

import duckdb
import pytest

from gridrun.queries import ORACLES, QUERIES, load_all, oracle

SF = "/root/testdata/sf0.001"
load_all()
SAMPLE = ["a04_counts_metrics", "r06_components", "j11_greedy_suppression", "q03_field_verification_queue", "w06_new_best",
          "r08_refine_roads", "r29_patch_catalog", "a49_preflight", "g01_streaming_counters", "r36_layer_table", "r02b_near_large_radius"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("key", SAMPLE)
def test_oracle(spark, con, key):
    df = QUERIES[key](spark, SF)
    res = con.execute(oracle(key))
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in res.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in sorted(cols)) for r in df.collect()), key=repr)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
