"""What a task holds: products in blocks, texts a few at a time, and no pairs of queries and all that they expect."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from corvane.operators import ann, chunking, stored_index, vector

N, Q = 10_000, 1_500


class Frame:
    """A frame that gives its function for Arrow batches away."""

    def __getattr__(self, name):
        return lambda *a, **k: self

    def mapInArrow(self, f, schema):  # noqa: N802
        self.run = f
        return self


def peak(run, batch) -> float:
    """MB that are allocated at once, without what is given out."""
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


@pytest.fixture(scope="module")
def many():
    r = np.random.default_rng(2)
    x, q = r.normal(size=(N, 64)), r.normal(size=(Q, 64))
    return x, SimpleNamespace(value=(np.arange(Q), vector.unit_rows(q)))


def lists_of(x):
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1]).astype(np.int32), pa.array(x.ravel().astype(np.float32)))


@pytest.mark.parametrize("by_tag", [False, True])
def test_products_of_exact_search(many, by_tag):
    """eval_end_to_end asks for groups."""
    x, sent = many
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(N)), lists_of(x), pa.array([f"=src/m{i % 50}.py" for i in range(N)])], names=["id", "e", "tag"])
    assert peak(vector.nearest(sent, 5, by_tag), batch) < 90


def test_products_of_codes(spark, many, monkeypatch):
    x, sent = many
    monkeypatch.setattr(ann, "query_blocks", lambda *a: [sent])
    frame = Frame()
    ann.search_codes(frame, None, 8)
    codes = pa.array([c.tobytes() for c in np.random.default_rng(1).integers(0, 256, (N, 32)).astype(np.uint8)], pa.binary())
    assert peak(frame.run, pa.RecordBatch.from_arrays([pa.array(np.arange(N)), codes], names=["id", "codes"])) < 70


def test_products_of_the_stored_index(spark, many, monkeypatch):
    """All codes of a batch are of one list, as they are stored, and all queries look into it."""
    x, sent = many
    monkeypatch.setattr(stored_index, "query_blocks", lambda *a: [sent])
    monkeypatch.setattr(stored_index, "settled", lambda df: df)
    model = stored_index.Model(vector.unit_rows(x[:1]), [np.random.default_rng(3).normal(size=(256, 8)) * 0.1 for _ in range(8)])
    frame = Frame()
    session = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v)))
    index = SimpleNamespace(spark=session, model=model, codes=SimpleNamespace(manifest=lambda: {}, _read=lambda *a: frame), vectors=SimpleNamespace(lookup=lambda *a: frame))
    with pytest.raises(Exception, match=".*"):  # the frame is none that could be joined
        stored_index.StoredIndex.search(index, frame, 8, probes=1)
        raise RuntimeError
    codes = pa.array([c.tobytes() for c in np.random.default_rng(1).integers(0, 256, (N, 8)).astype(np.uint8)], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(N, np.int32)), pa.array(np.arange(N)), codes, pa.array(np.zeros(N, np.float32))], names=["list", "id", "code", "error"])
    assert peak(frame.run, batch) < 90


def code_batch(codes, n):
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.full(n, 0.1, np.float32))], names=["list", "id", "code", "error"])


@pytest.mark.parametrize("files", [3, 50])
@pytest.mark.parametrize("by_tag", [False, True])
def test_products_of_equal_vectors(many, by_tag, files):
    """eval_end_to_end: copies, and files that hold most vectors of a block, are not all sorted."""
    x, sent = many
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(N)), lists_of(np.repeat(x[:1], N, 0)), pa.array([f"=src/m{i % files}.py" for i in range(N)])], names=["id", "e", "tag"])
    assert peak(vector.nearest(sent, 5, by_tag), batch) < 60


@pytest.mark.parametrize("lower", [False, True])
def test_products_of_equal_codes(many, lower):
    """vector_index_topk: copies have one code, and all of them the k-th best product."""
    x, sent = many
    model = stored_index.Model(vector.unit_rows(x[:1]), [np.random.default_rng(3).normal(size=(256, 8)) * 0.1 for _ in range(8)])
    run = stored_index._best(sent, SimpleNamespace(value=(model, {0: np.arange(Q)})), 32, lower)
    assert peak(run, code_batch(np.full((N, 8), 7, np.uint8), N)) < 60
    got = pa.Table.from_batches(run(iter([code_batch(np.full((N, 8), 7, np.uint8), N)]))).to_pydict()
    assert sorted(zip(got["query_id"], got["id"], strict=True)) == [(q, i) for q in range(Q) for i in range(32)]


@pytest.mark.parametrize("by_tag", [False, True])
def test_ties_of_many_blocks(by_tag):
    """Few different vectors, ids in no order: the nearest by similarity, then id, or of each file the best, then by file."""
    r = np.random.default_rng(5)
    n, k = 5_000, 7
    x = r.integers(-1, 2, (n, 3)).astype(np.float64)
    x[:40] = r.normal(size=(40, 3)) * 1e-4 + x[40:80]
    ids, tags = r.permutation(n), np.array([f"=m{i}.py" for i in r.integers(0, 40, n)])
    q = vector.unit_rows(r.integers(-1, 2, (1_100, 3)).astype(np.float64))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), lists_of(x), pa.array(tags)], names=["id", "e", "tag"])
    got = pa.Table.from_batches(vector.nearest(SimpleNamespace(value=(np.arange(1_100), q)), k, by_tag)(iter([batch.slice(0, 3_000), batch.slice(3_000)]))).to_pydict()
    found = {i: [] for i in range(1_100)}
    for i, row in zip(got["query_id"], zip(got["similarity"], got["id"], got["tag"], strict=True), strict=True):
        found[i].append(row)
    s = np.round(q @ vector.unit_rows(x.astype(np.float32).astype(np.float64)).T, 6) + 0.0
    for i in range(0, 1_100, 9):
        want = sorted(zip((-s[i]).tolist(), ids.tolist(), tags.tolist(), strict=True))
        if by_tag:
            best = {}
            for row in want:
                best.setdefault(row[2], row)
            want = sorted(best.values(), key=lambda row: (row[0], row[2]))
        assert found[i] == [(-a, b, c if by_tag else "") for a, b, c in want[:k]]


def test_chunks_of_long_texts(spark):
    """chunk_headings: a batch's texts and chunks are not held together."""
    text = "".join(f"# heading {i}\n" + "words of a line\n" * 30 for i in range(60))
    frame = Frame()
    frame.schema = {"id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}
    chunking.chunk(frame, "doc_id", "text", "lang")
    n = 1_500
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([text + str(i) for i in range(n)]), pa.array(["markdown"] * n)], names=["id", "text", "lang"])
    assert peak(frame.run, batch) < 20
    got = [r for b in frame.run(iter([batch.slice(0, 200)])) for r in b.to_pylist()]
    assert [(r["id"], r["ordinal"], r["text"]) for r in got] == [(i, k, c.text) for i in range(200) for k, c in enumerate(chunking.chunk_markdown(text + str(i)))]
