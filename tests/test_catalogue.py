"""Every query with SQL gives the same rows as the other engine; all others run."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from lexloom.plans import catalogue, oracles  # noqa: E402


@pytest.fixture(scope="session")
def other(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def table_of(df, columns):
    return sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, data, other, name):
    got = catalogue.queries()[name](spark, data).toPandas()
    sql = oracles.oracle_sql().get(name)
    if sql:
        want = other.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert table_of(got, sorted(got.columns)) == table_of(want, sorted(want.columns))


def test_sql_belongs_to_queries():
    assert set(oracles.oracle_sql()) <= set(catalogue.queries())


def test_sense_lines_of_all_entries(spark, data):
    parts = spark.read.parquet(f"{data}/definitions.parquet").selectExpr("def_id", "posexplode(entries) as (part, entry)").filter("entry is not null").select("def_id", "part")
    got = catalogue.queries()["sense_lines_all"](spark, data).select("def_id", "part").distinct()
    assert parts.filter("part > 0").count() and not parts.exceptAll(got).count() and not got.exceptAll(parts).count()
