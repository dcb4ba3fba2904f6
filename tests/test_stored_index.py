"""The stored vector index: recall and bytes, bounds, filters, upserts and deletions."""

import numpy as np
import pytest

from corvane.functions.shared import settled
from corvane.operators import ann, stored_index, vector
from corvane.operators.stored_index import FEW, Model, StoredIndex
from corvane.queries import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 32))
    x = centres[r.integers(0, 40, 4_000)] + r.normal(size=(4_000, 32)) * 0.35
    rows = [(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)] + [(4_000, [0.0] * 32, "a"), (4_001, None, "a")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, kind string").repartition(3).persist()


@pytest.fixture(scope="module")
def index(clustered, tmp_path_factory):
    return StoredIndex.build(clustered, str(tmp_path_factory.mktemp("i") / "x"), 40, 16, ("kind",), buckets=8)


def asked(df, every=200):
    return df.filter(f"vec_id % {every} = 7").selectExpr("vec_id as query_id", "embedding")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_recall_at_a_tenth_of_the_bytes(index, clustered, monkeypatch):
    """The codes of the probed lists are a tenth of the vectors' bytes at most, and nothing is fitted in a search."""
    exact = vector.batch_top_k(clustered, asked(clustered), 8)
    monkeypatch.setattr(Model, "fit", None)
    found = index.search(asked(clustered), 8, probes=3)
    assert ann.recall(found, exact) >= 0.9
    one = asked(clustered).limit(1).collect()[0]
    q = vector.unit_rows(np.array([one.embedding]))
    probed = np.argsort(-(q @ index.model.centres.T)[0])[:3].tolist()
    size = index.bytes_of(probed)
    assert 0 < size <= 4_001 * 32 * 4 / 10 and index.bytes_of() > 5 * size


def test_bounds_and_tables(index, clustered):
    x = np.array([r.embedding for r in clustered.filter("vec_id < 500").collect()])
    lists, codes, error = index.model.encode(x)
    u, q = vector.unit_rows(x), vector.unit_rows(np.random.default_rng(1).normal(size=(FEW + 5, 32)))
    for n in np.unique(lists)[:5]:
        own = np.flatnonzero(lists == n)
        few, many = index.model.products(q[:3], n, codes[own]), index.model.products(q, n, codes[own])
        assert np.allclose(few, many[:3]) and (np.abs(q @ u[own].T - many) <= error[own] + 1e-9).all()


def test_exact_equals_plain(index, clustered):
    for where in (None, "kind = 'b'"):
        own = clustered if where is None else clustered.filter(where)
        assert rows(index.search(asked(clustered), 8, where=where, exact=True)) == rows(vector.batch_top_k(own, asked(clustered), 8).select("query_id", "id", "similarity", "rank"))
    allowed = clustered.filter("vec_id % 3 = 0").selectExpr("vec_id as id")
    assert rows(index.search(asked(clustered), 5, allowed=allowed, exact=True)) == rows(vector.batch_top_k(clustered.filter("vec_id % 3 = 0"), asked(clustered), 5).select("query_id", "id", "similarity", "rank"))
    assert index.search(asked(clustered), 5, allowed=allowed.limit(0)).count() == 0
    assert index.search(asked(clustered).limit(0), 5).count() == 0
    assert index.search(asked(clustered), 9_000, where="kind = 'b' and id < 50", exact=True).count() == 20 * 25


def test_upserts_and_deletions(spark, clustered, tmp_path):
    index = StoredIndex.build(clustered, str(tmp_path / "x"), 20, 8, ("kind",), buckets=8)
    before = index.codes.manifest()["parts"]
    v = [float(i == 3) for i in range(32)]
    new = spark.createDataFrame([(5, v, "c"), (9_999, v, "c"), (12, None, "c"), (None, v, "c")], "vec_id long, embedding array<float>, kind string")
    index.upsert(new)
    index.upsert(new, writer=("w", 0))
    assert sum(index.codes.manifest()["parts"].get(b) != p for b, p in before.items()) <= 3
    q = spark.createDataFrame([(0, v)], "query_id long, embedding array<float>")
    assert [r.id for r in index.search(q, 2).orderBy("rank").collect()] == [5, 9_999]
    assert StoredIndex(spark, index.path).search(q, 9, where="kind = 'c'").count() == 2
    index.delete(spark.createDataFrame([(5,), (77_777,)], "id long"))
    assert index.search(q, 9, where="kind = 'c'").count() == 1 and index.codes.read().count() == index.vectors.read().count() == 4_001
    index.delete(index.vectors.read().select("id"))
    assert index.search(q, 9).count() == 0
    with pytest.raises(ValueError, match="one vector"):
        StoredIndex.build(clustered.limit(0), str(tmp_path / "y"))


def test_recall_of_the_query(spark):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    exact = vector.batch_top_k(e, e.filter("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding"), 8)
    assert ann.recall(queries()["vector_index_topk"](spark, SMALL), exact) >= 0.9


def test_exact_hands_on_no_pairs(spark, tmp_path, monkeypatch):
    """Vectors that are spread evenly have loose bounds: nearly all reach each query's. What a search writes is no row for each query and vector."""
    x = np.random.default_rng(6).normal(size=(3_000, 32))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    index, written = StoredIndex.build(vectors, str(tmp_path / "x"), 4, 4, buckets=4), []
    monkeypatch.setattr(stored_index, "settled", lambda df: written.append(settled(df)) or written[-1])
    found = rows(index.search(asked(vectors, 10), 8, exact=True))
    assert found == rows(vector.batch_top_k(vectors, asked(vectors, 10), 8).select("query_id", "id", "similarity", "rank"))
    assert max(df.count() for df in written) <= 3_000
