"""Chunkers in SQL, and fixtures that are parsed where they are read."""

import pytest

from corvane.functions import tables
from corvane.operators.chunking import Chunk, chunk_python
from corvane.plans.registry import Registry
from corvane.sources import files

PYTHON = "import os\n\n@cache\ndef f(a):\n    return a\n\n\nclass C:\n    x = 1\n"


@pytest.fixture
def source(spark):
    tables.register(spark)
    return spark.createDataFrame([("a.py", "python", PYTHON), ("b.txt", None, "one\n\ntwo"), ("c.txt", "none", None), ("d.md", "markdown", " \n")], "path string, language string, body string")


def test_lateral(spark, source):
    got = spark.sql("SELECT f.path, c.ordinal, c.name, c.kind, c.line_start, c.line_end, c.chunk FROM {f} f, LATERAL chunks(f.body, f.language) c", f=source).collect()
    want = [("a.py", n, c.name, c.kind, c.line_start, c.line_end, c.text) for n, c in enumerate(chunk_python(PYTHON))]
    assert sorted(r for r in map(tuple, got) if r[0] == "a.py") == want and [r.name for r in got if r.path == "b.txt"] == ["chunk#1"]
    assert not [r for r in got if r.path == "c.txt"]


def test_schema_follows_the_table(spark, source):
    got = spark.sql("SELECT * FROM file_chunks(TABLE({f}), text => 'body')", f=source)
    assert got.columns == ["path", "language", *tables.CHUNK.names]
    assert {(r.path, r.kind) for r in got.collect()} >= {("a.py", "function"), ("a.py", "class"), ("b.txt", "chunk")}
    for bad, told in (("TABLE({f})", "no column text"), ("TABLE(SELECT body AS text, 1 AS name FROM {f})", "a column name")):
        with pytest.raises(Exception, match=told):
            spark.sql(f"SELECT * FROM file_chunks({bad})", f=source).collect()


def test_partitions_in_order(spark, source):
    lines = spark.createDataFrame([(k, n, f"{k} line {n}" if n != 3 else None) for k in "ab" for n in range(9, -1, -1)], "k string, n int, text string").repartition(3)
    got = spark.sql("SELECT k, ordinal, line_start, line_end, chunk FROM line_chunks(TABLE({t}) PARTITION BY k ORDER BY n, most => 40)", t=lines).collect()
    for k in "ab":
        own = sorted((r.ordinal, r.line_start, r.chunk) for r in got if r.k == k)
        assert own[0][2].startswith(f"{k} line 0\n{k} line 1") and len(own) > 2 and all(len(c) <= 40 for _, _, c in own)


def test_own_chunkers(spark, source):
    registry = Registry()
    registry.chunker("none", lambda text: [Chunk("mine", "whole", 1, 1, text)])
    registry.register_tables(spark)
    got = spark.sql("SELECT c.name FROM (SELECT 'x' AS t) f, LATERAL chunks(f.t, 'none') c").collect()
    assert [r.name for r in got] == ["mine"]


def test_fixtures_and_broken_ones(spark, tmp_path):
    for name, text in {"a b.yml": "id: one\nquery: 5\nexpected: [x, 2]", "sub/c.yml": "id: two\nexpected: y", "d.yml": "id: [", "e.yml": "- list", "f.yml": "id: three", "_example.yml": "id: [", "g.txt": "id: four\nexpected: z"}.items():
        (tmp_path / "my f" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "my f" / name).write_text(text)
    got = sorted(tuple(r) for r in files.fixtures(spark, str(tmp_path / "my f")).collect())
    assert got == [("one", None, "5", ["x", "2"]), ("two", None, None, ["y"])]
    broken = {r.path: r.reason for r in files.broken_fixtures(spark, str(tmp_path / "my f")).collect()}
    assert set(broken) == {"d.yml", "e.yml", "f.yml"} and broken["d.yml"].startswith("not YAML") and broken["f.yml"] == "without expected"
