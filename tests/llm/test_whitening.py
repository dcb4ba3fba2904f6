"""Whitening against numpy and whole numbers of any size."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from corvane.llm import whitening
from corvane.llm.queries import queries

from ..conftest import SMALL


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def plain(rows, dim, components):
    """Fitted rows, deviations, covariance, and per row and component the whitened value up to its sign."""
    ok = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    n, s = len(ok), [sum(c) for c in zip(*(v for _, v in ok), strict=True)]
    deviation = [sum((n * x - t) ** 2 for x, t in zip(v, s, strict=True)) for _, v in ok]
    y = np.array([[float(Fraction(n * x - t, n)) for x, t in zip(v, s, strict=True)] for _, v in ok])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(e)[::-1][:components]
    return ok, deviation, v, e[order], y @ u[:, order]


def compare(got, rows, dim, components):
    ok, deviation, v, e, z = plain(rows, dim, components)
    table = {}
    for r in got:
        table.setdefault((r.vec_id, r.deviation), []).append(r)
    assert len(got) == len(ok) * min(components, dim)
    assert {int(d) for _, d in table} == set(deviation)
    assert all(r.n == len(ok) and r.identity_error < 1e-9 for r in got)
    for j in range(min(components, dim)):
        mine = {(r.vec_id, int(r.deviation)): r for r in got if r.component == j + 1}
        a = np.array([mine[i, d].whitened for (i, _), d in zip(ok, deviation, strict=True)])
        b = z[:, j] / math.sqrt(e[j])
        sign = np.sign(a @ b)
        assert np.abs(sign * a - b).max() < 1e-6
        assert all(math.isclose(r.explained, e[j] / np.trace(v), rel_tol=1e-9) for r in mine.values())


def test_query_equals_plain(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    compare(queries()["op13_embedding_whitening"](spark, SMALL).collect(), rows, 64, 32)


def test_odd_rows(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 4), r.gauss(2, 1), r.gauss(-50, 2)]) for i in range(40)]
    rows += [(None, [1.0, 2.0, 3.0]), (50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [float("-inf"), 1.0, 1.0]), (55, [1.0, 2.0])]
    df = frame(spark, rows)
    df = df.withColumn("n", df.vec_id).withColumn("whitened", df.vec_id).withColumn("x", df.embedding)
    compare(whitening.whiten(df, 2).collect(), rows, 3, 2)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id > 49 and vec_id < 52")).count() == 0
    assert whitening.whiten(df, dim=7).count() == 0
    with pytest.raises(Exception, match="an entry beyond"):
        whitening.whiten(frame(spark, [(1, [1e30])])).count()


def test_no_variance(spark):
    """Repeated rows and constant entries: components without variance have values of 0."""
    got = whitening.whiten(frame(spark, [(1, [0.5, 2.0]), (1, [0.5, 2.0]), (2, [0.5, 4.0])])).collect()
    assert sorted((r.vec_id, r.component, int(r.deviation), round(abs(r.whitened), 6), r.explained) for r in got if r.vec_id == 2) == [(2, 1, 65536, round(math.sqrt(2), 6), 1.0), (2, 2, 65536, 0.0, 0.0)]
    assert len(got) == 6 and max(r.identity_error for r in got) < 1e-12
    one = whitening.whiten(frame(spark, [(1, [0.5, 2.0])])).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in one] == [(0.0, 0.0, 0.0, 0)] * 2


def test_wide_sums(spark):
    """Products that 64 bits would not hold are summed in doubles, deviations as whole numbers of 38 digits."""
    r = random.Random(5)
    rows = [(i, [r.choice([-1, 1]) * 2.0**40 * r.random(), 2.0**40 * r.random()]) for i in range(50)]
    compare(whitening.whiten(frame(spark, rows)).collect(), rows, 2, 2)
    with pytest.raises(Exception, match="CAST_OVERFLOW|NUMERIC_VALUE_OUT_OF_RANGE|overflow"):
        got = whitening.whiten(frame(spark, rows))
        got.select(got["deviation"].cast("long")).collect()


def test_generated_sql():
    assert whitening.upper_triangle(2, True) == ["sum(y0 * y0) AS p0_0", "sum(y0 * y1) AS p0_1", "sum(y1 * y1) AS p1_1"]
    assert len(whitening.upper_triangle(64, False)) == 2080
