from pathlib import Path

import pytest

import __spark_entry__ as entry
from tessera.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    ours = registry.QUERIES[name](spark, str(DATA)).toPandas()
    theirs = con.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)

    def plain(v):
        if str(v) in ("None", "nan", "<NA>", "NaT"):
            return "null"
        return str(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)

    columns = sorted(ours.columns)
    assert sorted(tuple(map(plain, r)) for r in ours[columns].itertuples(index=False)) == sorted(tuple(map(plain, r)) for r in theirs[columns].itertuples(index=False))
