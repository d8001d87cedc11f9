"""Every query with SQL against DuckDB on the smallest tables; the others run and keep their columns."""

from pathlib import Path

import duckdb
import pytest

from maskara.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() and list(p.glob('*.parquet')) else '/*' if p.is_dir() else ''}')")
    return c


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    got, want = rows(registry.queries()[name](spark, SF).toPandas()), rows(con.execute(registry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.values.tolist() == want.values.tolist()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).limit(5).toPandas().shape[1] > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() == 24
