"""Every core query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from corvane.queries import oracle_sql, queries

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, duck, name):
    df = queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert len(set(df.columns)) == len(df.columns)
    if name not in oracle_sql():
        assert mine
        return
    found = duck.sql(oracle_sql()[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filter_reaches_the_scan(spark, capsys):
    spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").select("doc_id").explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)]" in plan
