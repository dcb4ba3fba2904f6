"""Katz backoff of higher orders, in many segments, against a plain recursion."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import katz
from corvane.llm.queries import queries

from ..conftest import SMALL
from .test_llm import docs, texts


def plain(rows, order):
    """score by document, by recursion over dictionaries; every context's distribution is checked to sum to 1."""
    every = [(i, [None, *(t or "").encode().lower().split(), b""]) for i, t in rows]
    train = [t for i, t in every if zlib.crc32(str(i).encode()) % 10]
    counts = [Counter(tuple(t[k : k + n]) for t in train for k in range(len(t) - n + 1) if n > 1 or k) for n in range(1, order + 1)]
    d = [katz.discounts([Counter(min(v, 7) for v in c.values())[r] for r in range(1, 8)]) for c in counts]
    n, n_docs = sum(counts[0].values()), len(train)
    vocabulary = [w for (w,) in counts[0]]
    left = 1 - sum(d[0][min(c, 6)] * c / n for c in counts[0].values())
    after = {}
    for k, c in enumerate(counts[1:], 2):
        for g in c:
            after.setdefault(g[:-1], []).append(g[-1])
    times = lambda h: n_docs if h == (None,) else counts[len(h) - 1][h]
    weights = {}

    def weight(h):
        if h not in weights:
            seen = after[h]
            weights[h] = (1 - sum(p(h, w) for w in seen)) / (1 - sum(p(h[1:], w) for w in seen))
        return weights[h]

    def p(h, w):
        if not h:
            return d[0][min(counts[0][w,], 6)] * counts[0][w,] / n if counts[0][w,] else left
        c = counts[len(h)][h + (w,)]
        if c:
            return d[len(h)][min(c, 6)] * c / times(h)
        return weight(h) * p(h[1:], w) if h in after else p(h[1:], w)

    for h in [*after][:: max(1, len(after) // 60)]:
        assert math.isclose(sum(p(h, w) for w in [*vocabulary, b"never seen"]), 1, rel_tol=1e-9)
    return {i: sum(math.log10(p(tuple(t[max(0, k - order + 1) : k]), t[k])) for k in range(1, len(t))) for i, t in every}


@pytest.mark.parametrize(("order", "segment"), [(3, 10**6), (3, 700), (4, 900), (2, 500)])
def test_orders_equal_plain(spark, order, segment):
    rows = texts(150, 8, 60, 12) + [(1000, ""), (1001, None), (1002, "never seen words"), (1003, "W1 w2"), (1004, "w1 w2 w1 w2 w1 w2")]
    want = plain(rows, order)
    got = katz.katz_scores(docs(spark, rows), order=order, segment=segment).collect()
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-7), r


def test_the_query_equals_plain(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = plain(rows, 3)
    got = {r.doc_id: r.score for r in queries()["op10_katz_lm_scoring"](spark, SMALL).collect()}
    assert set(got) == set(want) and all(math.isclose(got[i], want[i], rel_tol=1e-7) for i in want)


def test_counts_beyond_31_bits():
    import pyarrow as pa

    from corvane.llm.packed import pack, unpack

    part = lambda seg, n: (3, 1, seg, None, pack(np.array([5, 7], np.uint64), np.array([n, 1], np.uint32)))
    out = [b for b in katz._sum(iter([katz._messages([part(k, 0x7FFFFFFF) for k in range(5)])]))]
    total = unpack(pa.Table.from_batches(out).column("b")[4].as_py(), "<u8")[0] & katz._COUNT
    assert total.tolist() == [5 * 0x7FFFFFFF, 5]
