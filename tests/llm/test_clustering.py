"""Yinyang clustering against plain k-means in whole numbers, and its bounds against true distances."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import clustering

from ..conftest import SMALL


def plain(rows, k, rounds, dim, scale):
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 by the words of the contract."""
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(ok, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in first[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((d2(v, x), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in ok]
        for j in range(len(c)):
            if mine := [v for (_, v), o in zip(ok, own, strict=True) if o == j]:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in ok]
    of = {j: sum(d for _, o, d in found if o == j) for _, j, _ in found}
    return sorted(((i, j, d, of[j], sum(of.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found), key=repr)


def frame(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}").repartition(3)


def ran(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def grid(n, dim, seed, most=3):
    """Few different values, so distances tie."""
    r = random.Random(seed)
    return [(i, [float(r.randint(-most, most)) for _ in range(dim)]) for i in range(n)]


ODD = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (7, None), (8, [1.0]), (9, [1.0, None]), (10, [1.0, float("nan")]), (11, [float("inf"), 1.0]), (12, []), (13, [-0.5, -0.375]), (13, [-0.5, -0.375]), (13, [4.0, 4.0])]


@pytest.mark.parametrize(("rows", "k", "groups"), [(grid(120, 2, 1), 7, None), (grid(60, 3, 2, 1), 12, 3), (ODD + grid(20, 2, 3), 5, 2), (ODD, 40, None), ([(1, [0.5, 0.5])], 3, None)])
def test_equals_plain(spark, rows, k, groups, monkeypatch):
    dim = 3 if rows[0][1] and len(rows[0][1]) == 3 else 2
    monkeypatch.setattr(clustering, "BLOCK_BYTES", 100)  # several rows of vectors a task
    df = frame(spark, rows).withColumns({c: F.lit("x") for c in ("block", "ids", "x", "cluster", "distance")})
    got = ran(clustering.yinyang_clusters(df, k, 6, dim, 10.0, groups=groups))
    assert got == plain(rows, k, 6, dim, 10.0)


def test_query_equals_plain(spark):
    from corvane.llm.queries import queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert ran(queries()["op11_yinyang_clustering"](spark, SMALL)) == plain(rows, 8, 10, 64, 1024)


def test_nothing_to_cluster(spark):
    assert clustering.yinyang_clusters(frame(spark, ODD[2:8]), 3, 2, 2).count() == 0
    assert clustering.yinyang_clusters(frame(spark, ODD).limit(0), 3, 2, 2).count() == 0
    with pytest.raises(Exception, match="distances that 64 bits do not hold"):
        clustering.yinyang_clusters(frame(spark, [(1, [1e30, 1.0])]), 3, 2, 2).count()


def test_bounds_hold_and_filters_save(spark):
    """Centroids move at random: assignments equal a full scan, bounds stay on their sides, and most distances are left out."""
    r = np.random.default_rng(4)
    around = r.integers(-9_000, 9_000, (24, 6))
    x = (around[r.integers(0, 24, 3_000)] + r.integers(-60, 60, (3_000, 6))).astype("<i4")
    c = clustering.Centroids.start(around, 5)
    assert sorted(np.concatenate(c.groups).tolist()) == list(range(24)) and len(c.groups) > 1
    own = upper = lower = None
    for turn in range(6):
        own, upper, lower, taken = clustering.assign(x, c, own, upper, lower)
        d = ((x[:, None, :].astype(np.int64) - c.at[None]) ** 2).sum(axis=2)
        assert (own == d.argmin(axis=1)).all()
        assert (upper.astype(float) ** 2 >= d[np.arange(len(x)), own] * (1 - 1e-7)).all()
        for g, members in enumerate(c.groups):
            others = np.where(members[None] == own[:, None], np.iinfo(np.int64).max, d[:, members]).min(axis=1)
            assert (np.maximum(lower[:, g].astype(float), 0) ** 2 <= others * (1 + 1e-7)).all()
        assert turn == 0 or taken < len(x) * 24 / 3
        c = c.onward(c.at + r.integers(-20, 20, c.at.shape) * (r.random((24, 1)) < 0.5))


def test_large_numbers_are_exact():
    x, c = np.array([[2**27, -(2**27) + 1], [3, 4]]), np.array([[-(2**27), 2**27], [0, 0]])
    assert clustering.squared_distances(x, c).tolist() == [[sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in c.tolist()] for p in x.tolist()]


def test_rounds_take_fewer_distances(spark):
    log = []
    r = random.Random(6)
    rows = [(i, [r.choice([0, 50, 100]) + r.random(), r.choice([0, 50]) + r.random()]) for i in range(600)]
    clustering.yinyang_clusters(frame(spark, rows, "array<double>"), 6, 8, 2, log=log).count()
    assert log[0] == 3600 and min(log) < 1200
