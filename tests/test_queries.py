"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

from tidemark import catalog  # noqa: E402

ORACLE = catalog.oracle_sql()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.8g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v.isoformat() if isinstance(v, datetime.date) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    want = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    place = [want.columns.index(c) for c in order]
    assert got == sorted(tuple(plain(r[i]) for i in place) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() >= 0


@pytest.mark.parametrize("name", [n for n in sorted(catalog.queries()) if n.startswith("st_")])
def test_streams_read_tables_of_part_files(spark, tmp_path, name):
    for t in ("events", "orders", "lineitem", "customer", "supplier", "nation", "region"):
        spark.read.parquet(f"{DATA}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    show = lambda d: sorted(str([plain(v) for v in r]) for r in catalog.queries()[name](spark, d).collect())
    got = show(str(tmp_path))
    assert got and got == show(DATA)
