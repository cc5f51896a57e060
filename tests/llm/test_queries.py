"""Queries of the subpackage against SQL, and that all of them run."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from lexloom.llm import queries as Q  # noqa: E402

COLUMNS = {
    "p2_found": {"field", "row_key"}, "p3_found": {"field", "row_key"}, "p4_found": {"slot_a", "slot_b"}, "p5_found": {"row_a", "row_b"}, "p6_found": {"field", "row_key"},
    "p7_found": {"doc_id", "item_id"}, "p9_found": {"doc_id", "kind", "start_pos"},
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, data, name):
    got = Q.queries()[name](spark, data).toPandas()
    assert len(got)
    if name in COLUMNS:
        assert set(got.columns) == COLUMNS[name]
        assert not got.duplicated().any()
    if sql := Q.oracle_sql().get(name):
        c = duckdb.connect()
        for p in glob.glob(f"{data}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        want = c.execute(sql).df()
        rows = lambda df: sorted(map(str, df[sorted(want.columns)].astype(object).itertuples(index=False, name=None)))
        assert rows(got) == rows(want)
