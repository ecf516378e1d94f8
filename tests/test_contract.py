"""The driver's contract: every query runs on small data and agrees with its SQL; core imports nothing of llm."""

import ast
import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import DATA
from tidelog.plans import pipeline, reference

CORE = {**pipeline.queries(), **reference.queries()}
SQL = {**pipeline.SQL, **reference.SQL}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return int(v) if isinstance(v, float) and v.is_integer() else v

    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, tables, name):
    got, want = CORE[name](spark, DATA).toPandas(), tables.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(CORE.keys() - SQL.keys()))
def test_query_without_sql_runs(spark, name):
    assert CORE[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.queries().keys() >= CORE.keys() and entry.oracle_sql().keys() <= entry.queries().keys()


def test_core_does_not_import_llm():
    root = os.path.dirname(entry.__file__)
    for path in glob.glob(f"{root}/tidelog/**/*.py", recursive=True):
        if "/llm/" in path:
            continue
        for node in ast.walk(ast.parse(open(path).read())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path
