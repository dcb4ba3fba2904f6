"""Whitening of embeddings: covariance from one aggregation over the upper triangle, eigenvectors from LAPACK.

Each entry c becomes the whole number x = floor(64 * c) + 1000000. A first aggregation has count, sum, least and greatest x of each
dimension. A second one, of generated SQL, sums the products (x_i - m_i) * (x_j - m_j) for every pair i <= j, where m is the mean rounded to
a whole number, so products of small centred numbers are added up exactly; what rounding left of the means is taken off afterwards. The driver gets
d * (d + 1) / 2 numbers, whatever the table holds, fills in the lower triangle and decomposes it. Sums that might pass 64 bits by the first
aggregation's figures are made in doubles instead.

The whitened vectors' own covariance is then measured by the same kind of sums over all rows and compared with the identity.

Results for edge cases: a vector that is null or holds null or non-finite entries is dropped. Where dim is not given it is the most frequent
length of the others, the greatest of equally frequent ones, and vectors of other lengths are dropped too. A null id stays null, rows that repeat count and are returned
as often as they stand there. A component without variance, as in tables of few rows or of equal ones, has whitened values of 0 and no part in the
identity error. Equal eigenvalues keep LAPACK's order. An empty table gives an empty result. Other columns are not read, whatever their names. An entry
beyond 2^53 / 64 is an error, as is a deviation that the query's 64 bits do not hold; the operator's own has 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.clustering import finite
from corvane.llm.common import map_arrow

SCALE, SHIFT = 64, 1_000_000
#: Eigenvalues of this part of the largest count as none.
RANK = 1e-12


def upper_triangle(dim: int, exact: bool) -> list[str]:
    """SQL of the sums of centred products y_i * y_j, i <= j."""
    product = "y{0} * y{1}" if exact else "CAST(y{0} AS DOUBLE) * y{1}"
    return [f"sum({product.format(i, j)}) AS p{i}_{j}" for i in range(dim) for j in range(i, dim)]


def covariance(kept: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray] | None:
    """n, the sums S, the rounded means m and the covariance of x, a column of arrays of `dim` whole numbers."""
    spread = kept.select(F.count("*").alias("n"), *(f(F.get("x", F.lit(i))).alias(f"{c}{i}") for i in range(dim) for c, f in (("s", F.sum), ("a", F.min), ("b", F.max)))).first()
    n = spread["n"]
    if not n:
        return None
    sums = [spread[f"s{i}"] for i in range(dim)]
    mean = [(2 * s + n) // (2 * n) for s in sums]
    widest = max(max(spread[f"b{i}"] - m, m - spread[f"a{i}"]) for i, m in enumerate(mean))
    centred = kept.select(*(F.coalesce(F.get("x", F.lit(i)) - F.lit(m), F.lit(0)).alias(f"y{i}") for i, m in enumerate(mean)))  # never null, so sums need not look
    row = centred.selectExpr(*upper_triangle(dim, n * widest * widest < 1 << 63)).first()
    v = np.zeros((dim, dim))
    v[np.triu_indices(dim)] = [p / n for p in row]  # whole numbers divide with one rounding
    rest = np.array([(s - n * m) / n for s, m in zip(sums, mean, strict=True)])
    v -= np.triu(np.outer(rest, rest))
    return n, np.array(sums, object), np.array(mean, np.int64), v + np.triu(v, 1).T


def axes(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns that whiten, and each component's part of the trace; the largest eigenvalue first."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(values, kind="stable")[::-1][:components]
    e, u = values[order], vectors[:, order]
    full = e > RANK * max(values.max(), 0.0)
    return np.where(full, u / np.sqrt(np.where(full, e, 1.0)), 0.0), np.where(full, e, 0.0) / (np.trace(v) or 1.0)


RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 32, dim: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and each of the first components."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c")).filter(finite(F.col("c")) & (F.size("c") > 0))
    if dim is None:
        often = own.groupBy(F.size("c").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
        if not often:
            return spark.createDataFrame([], RESULT)
        dim = often[0]["d"]
    whole = lambda c: F.when(F.abs(c) < (1 << 53) // SCALE, F.floor(c * SCALE) + SHIFT).otherwise(F.raise_error(F.lit("an entry beyond 2^53 / 64")).cast("long"))
    kept = own.filter(F.size("c") == dim).select("vec_id", F.transform("c", whole).alias("x"))
    found = covariance(kept, dim)
    if found is None:
        return spark.createDataFrame([], RESULT)
    n, sums, mean, v = found
    w, explained = axes(v, components)
    rest = sums - n * mean.astype(object)  # n * x - S is n * (x - m) - rest
    shared = spark.sparkContext.broadcast((mean, np.array([r / n for r in rest]), w))

    def project(x: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        mean, off, w = shared.value
        y = x.flatten().to_numpy().reshape(-1, dim) - mean
        return y, (y - off) @ w

    def deviations(y: np.ndarray) -> list[int]:
        most = n * (int(np.abs(y).max(initial=0)) + 1)
        if dim * most * most < 1 << 63:
            z = n * y - rest.astype(np.int64)
            return (z * z).sum(axis=1).tolist()
        z = n * y.astype(object) - rest
        return (z * z).sum(axis=1).tolist()

    error = _identity_error(kept, project, n, w)
    k = w.shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = 256
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, each):
                batch = whole_batch.slice(at, each)
                y, z = project(batch.column(1))
                m = len(y)
                again = np.repeat(np.arange(m), k)
                deviation = pa.array(deviations(y), pa.decimal128(38, 0)).take(pa.array(again))
                columns = [batch.column(0).take(pa.array(again)), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n, np.int64), deviation, z.ravel(), np.tile(explained, m), np.full(m * k, error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.transform(map_arrow, rows, RESULT)


def _identity_error(kept: DataFrame, project, n: int, w: np.ndarray) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity. Tasks send k * k sums, added up by entry."""
    k = w.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            z = project(batch.column(0))[1]
            total += np.column_stack([z.T @ z, z.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * (k + 1))), pa.array(total.ravel())], names=["at", "s"])

    found = kept.select("x").transform(map_arrow, sums, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    total = np.zeros(k * (k + 1))
    total[[r["at"] for r in found]] = [r["s"] for r in found]
    total = total.reshape(k, k + 1) / n
    full = np.abs(w).any(axis=0)
    found = total[:, :k] - np.outer(total[:, k], total[:, k]) - np.eye(k)
    return float(np.abs(found[np.ix_(full, full)]).max(initial=0.0))
