import duckdb
import pytest

from sparkloam.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _same(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_same(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.sql(catalog.oracle_sql()[name])
    assert cols == sorted(found.columns)
    want = sorted((tuple(_same(v) for v in r) for r in found.select(", ".join(f'"{c}"' for c in cols)).fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["event_id", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
