"""The SQL of queries whose pairs SQL can list on small tables."""

import duckdb
import pytest

from corvane.llm import jaccard_join, line_dedup
from corvane.llm.queries import oracle_sql, queries

from ..conftest import SMALL
from .test_llm import docs, texts


def rows(frame, names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found, mine = c.sql(oracle_sql()[name]), queries()[name](spark, SMALL)
    assert sorted(found.columns) == sorted(mine.columns)
    assert rows(mine, found.columns) == sorted(found.fetchall(), key=repr)


def test_sql_on_odd_texts(spark):
    base = [t for _, t in texts(12, 4, 120, 60)]
    given = [(i, t) for i, t in enumerate([*base, base[0], base[1] + "\nmore words here.", "x\n" + base[2], None, "", " \n", "a b", "A b", "a\x0bb c d e f g", "a b c d e F G", base[3].replace("\n", "\r\n"), base[4] + "\n\n" + base[5]])]
    frame = docs(spark, given)
    c = duckdb.connect()
    c.register("documents", frame.toPandas())
    found = c.sql(line_dedup.ORACLE_SQL)
    assert rows(line_dedup.repeated_runs(frame), found.columns) == sorted(found.fetchall(), key=repr)
    found = c.sql(jaccard_join.ORACLE_SQL)
    assert rows(jaccard_join.jaccard_components(frame), found.columns) == sorted(found.fetchall(), key=repr)
