"""Every registered query against its DuckDB SQL on the driver's tables."""

import math
import os

import duckdb
import pytest
from conftest import DATA

from lodestar.plans.registry import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    q = QUERIES[name]
    df = q.run(spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if not q.sql:
        assert got
        return
    cursor = duck.execute(q.sql)
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    assert got == sorted(tuple(norm(r[found.index(c)]) for c in columns) for r in cursor.fetchall())


def test_results_do_not_depend_on_partitions(spark):
    for name in ("recipient_leaderboard", "text_reuse_clusters", "resolve_cascade"):
        results = []
        for n in ("3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(str, QUERIES[name].run(spark, DATA).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert results[0] == results[1]


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
