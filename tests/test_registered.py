import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
WITHOUT_SQL = {"file_manifest", "folder_hash", "dataset_fingerprint", "train_and_pick", "candidate_sweep", "tree_importance"}
SAMPLE = ("outlier_summary", "parse_area_text", "lookup_decode", "dedup_coalesce", "group_fill", "locality_encoding", "stratified_split", "within_tolerance", "request_validation")


def test_every_query_has_sql_but_the_known_few():
    own = {name for area in (entry.cleaning, entry.loading, entry.modelling, entry.market_tables) for name in area.QUERIES}
    assert own - set(entry.oracle_sql()) == WITHOUT_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    got = entry.queries()[name](spark, FOLDER)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(rel.columns)
    cols = sorted(got.columns)
    want = [tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()]
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(repr, want))
