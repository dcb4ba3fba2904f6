"""Stored tables in buckets, and graphs in them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.sources.buckets import BucketTable, Conflict

SCHEMA = "id long, name string, n int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).glob("data/**/*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], 8)
    t.upsert(spark.range(100).select("id", F.concat(F.lit("a"), "id").alias("name"), F.lit(0).alias("n")))
    return t


def test_an_upsert_leaves_other_buckets(spark, table):
    before, parts = files(table.path), table.manifest()["parts"]
    table.upsert(spark.createDataFrame([(3, "new", 1), (1000, "more", 2)], SCHEMA))
    touched = {str(b) for (b,) in spark.createDataFrame([(3,), (1000,)], "id long").select(table.bucket_of()).collect()}
    now = table.manifest()["parts"]
    assert {b for b in now if now[b] != parts.get(b)} == touched and len(touched) < 8
    assert all(files(table.path)[f] == t for f, t in before.items())
    got = {r.id: (r.name, r.n) for r in table.read().collect()}
    assert len(got) == 101 and got[3] == ("new", 1) and got[1000] == ("more", 2) and got[4] == ("a4", 0)


def test_a_reader_keeps_its_state(spark, table):
    old = table.read()
    table.upsert(spark.createDataFrame([(3, "new", 1)], SCHEMA), deleted=spark.createDataFrame([(4,), (None,)], "id long"))
    assert (3, "a3", 0) in rows(old) and old.count() == 100 and (3, "a3", 0) in rows(table.read(1))
    assert (3, "new", 1) in rows(table.read()) and table.read().count() == 99
    assert BucketTable(spark, table.path).read().count() == 99


def test_equals_a_rewrite_of_the_whole(spark, tmp_path):
    import random

    r, plain = random.Random(3), {}
    t = BucketTable(spark, str(tmp_path / "t"), "k string, j int, v int", ["k", "j"], 5)
    for turn in range(5):
        new = [(r.choice(["a", "b", None]), r.choice([1, 2, None]), r.randrange(100)) for _ in range(r.choice([0, 1, 6]))]
        gone = [(r.choice(["a", "b", None]), r.choice([1, 2, None])) for _ in range(2)]
        for k in gone:
            plain.pop(k, None)
        for k in {x[:2] for x in new}:
            plain[k] = [x for x in new if x[:2] == k]
        t.upsert(spark.createDataFrame(new, "k string, j int, v int"), spark.createDataFrame(gone, "k string, j int"))
        assert rows(t.read()) == sorted((x for own in plain.values() for x in own), key=repr)
    found = rows(t.lookup(spark.createDataFrame([("a", None), (None, 1)], "k string, j int")))
    assert found == sorted((x for k in (("a", None), (None, 1)) for x in plain.get(k, [])), key=repr)


def test_the_latest_of_equal_keys(spark, table):
    table.upsert(spark.createDataFrame([(3, "x", 1), (3, "y", 7), (3, "z", 5)], SCHEMA), order="n")
    assert [r for r in rows(table.read()) if r[0] == 3] == [(3, "y", 7)]


def test_a_batch_that_is_run_again(spark, table):
    change = spark.createDataFrame([(3, "once", 1)], SCHEMA)
    v = table.upsert(change, writer=("s", 4))
    assert table.upsert(spark.createDataFrame([(3, "twice", 1)], SCHEMA), writer=("s", 4)) == v and table.done("s") == 4 and table.done("other") == -1
    assert (3, "once", 1) in rows(table.read())
    assert table.upsert(change.limit(0), writer=("s", 5)) == v + 1 and table.done("s") == 5


def test_two_writers(spark, table, monkeypatch):
    """The second writer's buckets are kept where the first touched others, and made again where it did not."""
    other, made = BucketTable(spark, table.path), []
    write = BucketTable._write
    bucket = {r.id: r.b for r in spark.range(100).select("id", table.bucket_of().alias("b")).collect()}
    apart = next(i for i in range(100) if bucket[i] != bucket[3])
    beside = next(i for i in range(4, 100) if bucket[i] == bucket[3])

    def slow(self, *given):
        at = write(self, *given)
        if self is table:
            made.append(at)
            if len(made) == 1:
                other.upsert(spark.createDataFrame([(victim, "other", 9)], SCHEMA))
        return at

    monkeypatch.setattr(BucketTable, "_write", slow)
    for victim, times in ((apart, 1), (beside, 2)):
        made.clear()
        table.upsert(spark.createDataFrame([(3, "mine", victim)], SCHEMA))
        assert len(made) == times
        assert {(3, "mine", victim), (victim, "other", 9)} <= set(rows(table.read()))
    monkeypatch.setattr("corvane.sources.folders.Folder.write_json", lambda *a, **k: False)
    with pytest.raises(Conflict):
        table.upsert(spark.createDataFrame([(3, "never", 0)], SCHEMA))


def test_old_versions_go(spark, table):
    for n in range(5):
        table.upsert(spark.createDataFrame([(n, "n", n)], SCHEMA))
    before = rows(table.read())
    table.forget(2)
    assert table.versions() == [5, 6] and rows(table.read()) == before and table.read(5).count() == 100
    used = {p for v in (5, 6) for ps in table.manifest(v)["parts"].values() for p in ps}
    assert {str(Path(f).parent) for f in files(table.path)} == used or {str(Path(f).parent) for f in files(table.path)} >= used


def test_hot_key_and_nothing(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), SCHEMA, ["name"], 4)
    assert t.read().count() == 0 and t.upsert(spark.createDataFrame([], SCHEMA)) == 0
    t.upsert(spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("name"), F.lit(1).alias("n")))
    assert t.read().count() == 3000 and t.lookup(spark.createDataFrame([(None,)], "name string")).count() == 2000
    t.delete(spark.createDataFrame([(None,)], "name string"))
    assert t.read().count() == 1000
    with pytest.raises(ValueError, match="no table"):
        BucketTable(spark, str(tmp_path / "none"))
