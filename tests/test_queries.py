"""Every query runs, and those with SQL give DuckDB's rows."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from jobloom.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = list(catalog.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{SF}/{name}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v) if isinstance(v, list) else v


def rows(found, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows(cursor.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_package():
    for top, _, files in os.walk(os.path.join(os.path.dirname(entry.__file__), "jobloom")):
        for f in files:
            if f.endswith(".py") and f"{os.sep}llm" not in top:
                assert not re.search(r"jobloom[.]llm|from [.]+llm", open(os.path.join(top, f)).read()), f


def test_snoozes_are_counted_for_every_running_job(spark):
    from jobloom.sources.fixtures import Tables

    ids = sorted(r.id for r in Tables(spark, SF).jobs.filter("status = 'running'").select("id").collect())
    assert ids == sorted(r.id for r in catalog.queries()["rt4_snooze_count"](spark, SF).collect())
