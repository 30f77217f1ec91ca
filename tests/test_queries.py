"""Every query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from factloom.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for p in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v + 0.0:.7g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, db, name):
    df = registry.queries()[name](spark, data)
    cols = sorted(df.columns)
    rel = db.execute(SQL[name])
    have = [x[0] for x in rel.description]
    assert sorted(have) == cols
    at = [have.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_imports_nothing_optional():
    root = Path(registry.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert ".llm" not in p.read_text(), p
