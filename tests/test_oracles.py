"""Every query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import importlib
import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

CORE = [(name, q, m.SQL[name]) for m in (importlib.import_module(f"engramix.plans.{n}") for n in entry.CORE) for name, q in m.QUERIES.items() if name in m.SQL]
PLAIN = [(name, q) for m in (importlib.import_module(f"engramix.plans.{n}") for n in entry.CORE) for name, q in m.QUERIES.items() if name not in m.SQL]


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return f"{float(value):.6g}" if isinstance(value, float) else str(value)


def rows(frame, columns):
    return sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False))


def database(folder):
    db = duckdb.connect()
    for path in Path(folder).iterdir():
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name,query,sql", CORE, ids=[c[0] for c in CORE])
def test_core_query_equals_sql(spark, folder, name, query, sql):
    got, want = query(spark, folder).toPandas(), database(folder).execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    for c in columns:  # integers with nulls come as floats from one side
        if pd.api.types.is_numeric_dtype(got[c]) and pd.api.types.is_integer_dtype(want[c]):
            got[c] = got[c].astype("Int64")
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name,query", PLAIN, ids=[c[0] for c in PLAIN])
def test_core_query_runs(spark, folder, name, query):
    assert query(spark, folder).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_does_not_import_llm():
    root = Path(entry.__file__).parent
    for path in (root / "engramix").rglob("*.py"):
        if "llm" not in path.parts:
            assert "engramix.llm" not in path.read_text()
