"""Clustering of vectors about centroids by Yinyang's bounds, in whole numbers, so that every distance and every tie is exact.

Components x become floor(scale * x). Rounds are those of plain k-means, and so are results. Centroids are put into groups once, by their
places at the start. Each vector keeps an upper bound of the distance to its own centroid and, for each group, one lower bound of the distances to
the group's others. When centroids move, bounds move as far. A vector whose least lower bound exceeds its upper bound stays where it is
(the global filter); of the others, with the upper bound made exact, only groups whose bound does not exceed the best distance so far are
looked at (the group filter), and all centroids of those are compared exactly. Bounds are kept as 4 bytes, rounded outwards, and a bound that
equals a distance never excludes, so filters cannot change a tie.

Vectors are written once, some hundred to a row, in buckets; bounds are a table of their own in the same buckets, so a round joins both
without a shuffle, reads the vectors, and writes 8 bytes and 4 a group for each. Sums of clusters follow from what moved, added up in the tasks first.
Centroids, k times the dimension whatever the table holds, go through the driver. Once no centroid moves, later rounds would change nothing
and are left out.

Results for edge cases: vectors that are null, of another length, or hold null or non-finite components are left out. A null id stays null and is drawn
as a first centroid last; ids that repeat are drawn in the order of their vectors, then all alike. Fewer vectors than k make as many centroids.
Equal distances go to the smaller number. An empty cluster keeps its centroid. An empty table gives an empty result. Other columns are not read,
whatever their names. A component whose squared distances could pass 64 bits is an error.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, map_arrow

#: Bytes of a row of vectors and of a bucket of rows.
BLOCK_BYTES, BUCKET_BYTES, MOST_BUCKETS = 1 << 18, 64 << 20, 65_536
#: Centroids of a group, about.
GROUP = 10
#: The lower bound of a group that has no other centroid: beyond all distances, and finite, so that moves may be taken off it.
FAR = np.float32(1e30)


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor values that are not finite."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of each row of x to each row of c, exactly; the largest must fit 62 bits."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64  # doubles hold such whole numbers exactly, in any order of sums
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


class Centroids:
    """Centroids and their groups; how far each, and the farthest of each group, has moved since the round before."""

    def __init__(self, at: np.ndarray, groups: list[np.ndarray], moved: np.ndarray | None = None):
        self.at, self.groups = at, groups
        self.moved = np.zeros(len(at)) if moved is None else moved
        self.group_moved = np.array([self.moved[g].max(initial=0) for g in groups])
        self.group_of = np.zeros(len(at), np.int64)
        for i, g in enumerate(groups):
            self.group_of[g] = i

    def onward(self, at: np.ndarray) -> Centroids:
        step = (at - self.at).astype(np.float64)
        return Centroids(at, self.groups, np.sqrt((step * step).sum(axis=1)) * (1 + 1e-12))

    @classmethod
    def start(cls, at: np.ndarray, groups: int) -> Centroids:
        """Groups by a few rounds of k-means among the centroids alone."""
        centers = at[np.linspace(0, len(at) - 1, min(groups, len(at))).astype(int)].astype(np.float64)
        for _ in range(5):
            own = ((at[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2).argmin(axis=1) if len(at) * len(centers) * at.shape[1] < 1 << 24 else np.array([((a - centers) ** 2).sum(axis=1).argmin() for a in at])
            for g in np.unique(own):
                centers[g] = at[own == g].mean(axis=0)
        return cls(at, [np.flatnonzero(own == g) for g in np.unique(own)])


def assign(x: np.ndarray, c: Centroids, own: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row of x, its upper bound and the groups' lower bounds, from those before centroids moved; and how many distances it took."""
    n, most = len(x), np.iinfo(np.int64).max
    if own is None:
        rows, taken = np.arange(n), 0
        own, lower, old, best = np.zeros(n, np.int64), np.zeros((n, len(c.groups)), np.float32), None, np.full(n, most)
        upper = np.zeros(n, np.float32)
    else:
        upper = _up(upper.astype(np.float64) + c.moved[own])
        lower = lower.astype(np.float64)
        lower = _down(lower - c.group_moved - 1e-12 * (np.abs(lower) + c.group_moved))
        least = lower.min(axis=1)
        rows = np.flatnonzero(least <= upper)
        best = _to_own(x[rows], c.at[own[rows]])
        upper[rows] = _up(np.sqrt(best.astype(np.float64)))
        taken = len(rows)
        near = least[rows] <= upper[rows]
        rows, best = rows[near], best[near]
        old = own[rows]
    new, first_best = (np.zeros(len(rows), np.int64) if old is None else old.copy()), best.copy()
    scanned = []
    for g, members in enumerate(c.groups):
        look = np.arange(len(rows)) if old is None else np.flatnonzero(lower[rows, g] <= _up(np.sqrt(best.astype(np.float64))))
        if not len(look):
            continue
        d = squared_distances(x[rows[look]], c.at[members])
        taken += d.size
        at, each = d.argmin(axis=1), np.arange(len(look))
        nearest, which = d[each, at], members[at]
        d[each, at] = most
        scanned.append((g, look, nearest, which, d.min(axis=1)))
        better = (nearest < best[look]) | (nearest == best[look]) & (which < new[look])
        best[look[better]], new[look[better]] = nearest[better], which[better]
    if old is not None:  # the centroid that a vector left is one of its group's others now
        left = np.flatnonzero(new != old)
        g = c.group_of[old[left]]
        lower[rows[left], g] = np.minimum(lower[rows[left], g], _down(np.sqrt(first_best[left].astype(np.float64))))
    for g, look, nearest, which, second in scanned:
        others = np.where(which == new[look], second, nearest)
        lower[rows[look], g] = np.where(others == most, FAR, _down(np.sqrt(others.astype(np.float64))))
    own = own.copy()
    own[rows] = new
    upper[rows] = _up(np.sqrt(best.astype(np.float64)))
    return own, upper, lower, taken


def _to_own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = x.astype(np.int64) - c
    return (step * step).sum(axis=1)


def _moved(x: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Clusters that rows of x came to or left, and for each the count and the sums that it gained."""
    which = np.arange(len(x)) if old is None else np.flatnonzero(old != new)
    x = np.column_stack([np.ones(len(which), np.int64), x[which].astype(np.int64)])
    both = new[which] if old is None else np.concatenate([new[which], old[which]])
    clusters, at = np.unique(both, return_inverse=True)
    gain = np.zeros((len(clusters), x.shape[1]), np.int64)
    np.add.at(gain, at[: len(which)], x)
    if old is not None:
        np.subtract.at(gain, at[len(which) :], x)
    return clusters, gain


class _Buckets:
    """Tables in buckets of the column block, in the scratch folder: joins of them need no shuffle."""

    def __init__(self, scratch: Scratch, n: int):
        self.scratch, self.n, self.names = scratch, n, {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path, name = self.scratch.path(label), f"corvane_{label}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.n, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
        out = self.scratch.spark.table(name)
        out._corvane_path = path  # type: ignore[attr-defined]
        self.names[path] = name
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self.scratch.spark.sql(f"DROP TABLE IF EXISTS {self.names[df._corvane_path]}")
        self.scratch.drop(*frames)


def _whole(x: np.ndarray, dim: int, scale: float) -> np.ndarray:
    x, bound = np.floor(scale * x), min(math.isqrt((1 << 62) // (4 * dim)), 1 << 31)
    if np.abs(x).max(initial=0) >= bound:
        raise ValueError(f"a component beyond {bound / scale} has distances that 64 bits do not hold")
    return x.astype(np.int64)


def _blocks(kept: DataFrame, dim: int, scale: float) -> DataFrame:
    """Rows of block, ids and their vectors' whole numbers, of 4 bytes each."""
    rows = max(1, BLOCK_BYTES // (4 * dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, np.ndarray]] = []

        def take(n: int) -> pa.RecordBatch:
            nonlocal block
            ids, x = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
            out = pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids[:n].to_pylist()], pa.list_(pa.int64())), pa.array([x[:n].tobytes()], pa.binary())], names=["block", "ids", "x"])
            block += 1
            held[:] = [(ids[n:], x[n:])] if len(ids) > n else []
            return out

        for batch in batches:
            x = _whole(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), dim, scale)
            held.append((batch.column(0), x.astype("<i4")))
            while sum(len(h[0]) for h in held) >= rows:
                yield take(rows)
        if held:
            yield take(rows)

    return kept.transform(map_arrow, run, "block long, ids array<long>, x binary")


_STATE = "block long, own binary, upper binary, lower binary, clusters array<int>, gain binary, taken long"


def _unpacked(own: bytes | None, upper: bytes | None, lower: bytes | None) -> list[np.ndarray | None]:
    if own is None:
        return [None] * 3
    return [np.frombuffer(own, "<i4").astype(np.int64), np.frombuffer(upper, "<f4"), np.frombuffer(lower, "<f4").reshape(len(own) // 4, -1)]


def _next_state(blocks: DataFrame, state: DataFrame | None, c: Centroids, dim: int) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(c)
    names = ["block", "own", "upper", "lower", "clusters", "gain", "taken"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for block, packed, *before in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                x = np.frombuffer(packed, "<i4").reshape(-1, dim)
                old = _unpacked(*before) if before else [None] * 3
                own, upper, lower, taken = assign(x, c, *old)
                clusters, gain = _moved(x, old[0], own)
                row = [block, own.astype("<i4").tobytes(), upper.astype("<f4").tobytes(), lower.astype("<f4").tobytes(), clusters.tolist(), gain.tobytes(), taken]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    return _with_state(blocks.select("block", "x"), state).transform(map_arrow, run, _STATE)


def _with_state(blocks: DataFrame, state: DataFrame | None) -> DataFrame:
    return blocks if state is None else blocks.join(state.select("block", "own", "upper", "lower").hint("shuffle_hash"), "block")


def _gains(state: DataFrame, k: int, dim: int) -> np.ndarray:
    """Count and sums that each cluster gained: k rows. Tasks add theirs up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for clusters, gain in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for j, row in zip(clusters, np.frombuffer(gain, np.int64).reshape(-1, dim + 1), strict=True):
                    total[j] = total[j] + row if j in total else row
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["cluster", "gain"])

    each = state.select("clusters", "gain").transform(map_arrow, run, "cluster int, gain array<long>")
    found = each.select("cluster", F.posexplode("gain").alias("at", "v")).groupBy("cluster", "at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((k, dim + 1), np.int64)
    out[found["cluster"].to_numpy(), found["at"].to_numpy()] = found["v"].to_numpy()
    return out


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def yinyang_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: float = 1024.0, salt: str = "3:", groups: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", log: list | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector. The first centroids are the k vectors with the least SHA-256 of salt and id.

    log: gets the number of distances that each round took.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "clusters")
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).filter((F.size("x") == dim) & finite(F.col("x")))
    drawn = kept.withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    if not drawn:
        return spark.createDataFrame([], RESULT)
    c = Centroids.start(_whole(np.array([r["x"] for r in drawn]), dim, scale), groups or max(2, -(-k // GROUP)))
    k = len(drawn)

    raw = scratch.keep(_blocks(kept, dim, scale), "raw")
    n = raw.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = _Buckets(scratch, min(MOST_BUCKETS, max(most, -(-n * dim * 4 // BUCKET_BYTES))))
    blocks = buckets.keep(raw.repartition(buckets.n, "block"), "blocks")
    scratch.drop(raw)

    totals, state = np.zeros((k, dim + 1), np.int64), None
    for _ in range(rounds):
        before, state = state, buckets.keep(_next_state(blocks, state, c, dim), "state")
        if before is not None:
            buckets.drop(before)
        if log is not None:
            log.append(state.agg(F.sum("taken")).first()[0])
        totals += _gains(state, k, dim)
        full = totals[:, 0] > 0
        at = c.at.copy()
        at[full] = totals[full, 1:] // totals[full, :1]
        c = c.onward(at)
        if not c.moved.any():
            break
    placed = scratch.keep(_placed(blocks, state, c, dim), "placed")
    sums = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    digest = lambda j: hashlib.sha256(",".join(map(str, c.at[j].tolist())).encode()).hexdigest()
    known = spark.createDataFrame([(j, s, sum(sums.values()), digest(j)) for j, s in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    buckets.drop(blocks, *[state] * (state is not None))
    return placed.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _placed(blocks: DataFrame, state: DataFrame | None, c: Centroids, dim: int) -> DataFrame:
    """vec_id, cluster and distance of each vector."""
    shared = blocks.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for _, ids, packed, *before in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                x = np.frombuffer(packed, "<i4").reshape(-1, dim)
                own = assign(x, c, *(_unpacked(*before) if before else ()))[0]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own.astype(np.int32)), pa.array(_to_own(x, c.at[own]))], names=["vec_id", "cluster", "distance"])

    return _with_state(blocks.select("block", "ids", "x"), state).transform(map_arrow, run, "vec_id long, cluster int, distance long")


def _oracle(rounds: int = 10, k: int = 8, dim: int = 64) -> str:
    """The rounds one after another, all vectors with all centroids in each."""
    steps = range(1, dim + 1)
    distance = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in steps)
    parts = [
        f"p AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: isfinite(e))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT k, x AS c FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS k, x FROM p) WHERE k < {k})",
    ]
    for j in range(rounds + 1):
        parts.append(f"a{j} AS MATERIALIZED (SELECT * FROM (SELECT r, vec_id, x, k, {distance} AS d FROM p, c{j}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if j < rounds:
            parts.append(f"n{j} AS (SELECT k, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT k, i, sum(v) AS s, count(*) AS n FROM (SELECT k, unnest(range(1, {dim + 1})) AS i, unnest(x) AS v FROM a{j}) GROUP BY k, i) GROUP BY k)")
            parts.append(f"c{j + 1} AS MATERIALIZED (SELECT c{j}.k, coalesce(n{j}.c, c{j}.c) AS c FROM c{j} LEFT JOIN n{j} ON n{j}.k = c{j}.k)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k"""


ORACLE_SQL = _oracle()
