"""Buckets and segments of the two shuffles by hash, hot tokens, and near copies by row."""

import random

import numpy as np
import pytest

from corvane.llm import jaccard_join, packed

from .test_llm import docs, plain_components


@pytest.mark.parametrize("volume", [0, 10**9, 393 * 10**9, 10**14])
def test_buckets_are_ranges_of_hashes(volume):
    b = packed.Buckets(volume)
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 50_000, dtype=np.uint64))
    which, edges = b.edges(h)
    assert (np.repeat(which, np.diff(edges)) == b.of(h)).all() and (np.diff(b.of(h).astype(np.int64)) >= 0).all() and int(b.of(h).max()) < b.n
    for k, lo in zip(which[::997].tolist(), edges[:-1:997].tolist(), strict=True):
        assert b.base(k) <= b.short(h)[lo] and (k + 1 == b.n or b.short(h)[lo] < b.base(k + 1))
    assert b.n * packed.BUCKET_BYTES >= volume - packed.BUCKET_BYTES and b.partitions <= packed.MOST_PARTITIONS
    assert len({b.any(k << packed.SEGMENT_BITS) for k in range(1_000)}) > min(b.n, 1_000) // 2


def test_segment_numbers_never_meet():
    assert packed.next_segment(packed.first_segment(3)) == (3 << packed.SEGMENT_BITS) + 1
    with pytest.raises(ValueError, match="segments"):
        packed.next_segment(packed.first_segment(4) - 1)
    with pytest.raises(ValueError, match="partitions"):
        packed.first_segment(1 << packed.PARTITION_BITS)


@pytest.mark.parametrize("seed", range(2))
def test_hot_tokens_equal_plain(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    r = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for _ in range(60):  # texts that share passages, but are no copies, among some that are
        x = common[: r.randint(5, 30)] + [f"u{r.randrange(12)}" for _ in range(r.randint(0, 12))]
        rows += [(len(rows), " ".join(x))] + [(len(rows) + 1, " ".join([*x, "more"]))] * (r.random() < 0.4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(docs(spark, rows), segment=300, heavy=4).collect()}
    assert got == plain_components(rows)


def test_near_copies_by_row(spark):
    a, b, c = "a b c d e f g h i j", "a b c d e f g h i j k", "something else that is not like the others at all"
    rows = [(1, a), (3, a), (3, c), (3, c), (None, b), (None, "x " + c + " y z"), (4, None), (4, None), (5, " "), (None, "w1 w2 w3"), (7, "w1 w2  w3"), (8, "q " * 30_000)]
    got = sorted(((x.doc_id, x.text) for x in jaccard_join.drop_near_copies(docs(spark, rows), by_row=True).collect()), key=repr)
    assert got == sorted([(1, a), (3, c), (None, "x " + c + " y z"), (4, None), (4, None), (5, " "), (7, "w1 w2  w3"), (8, "q " * 30_000)], key=repr)
    assert jaccard_join.drop_near_copies(docs(spark, rows).limit(0), by_row=True).count() == 0
    many = [(i // 2, f"{a} {i // 4}") for i in range(24)]
    kept = jaccard_join.drop_near_copies(docs(spark, many), by_row=True).collect()
    want = {c for _, c in plain_components(list(dict(many).items())).values()}
    assert len(kept) == len(want) and {x.doc_id for x in kept} == want
