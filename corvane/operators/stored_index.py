"""A stored vector index: lists of residual product codes, searched by tables of partial products.

The model is fitted once, on a bounded sample: list centres, and for each part of the dimensions up to 256 values of what a vector's centre leaves of it.
A vector is its list, a byte for each part, and how far its code is from it. Codes are stored by list and vectors by id, both in buckets:
a search reads the codes of the lists that its queries probe, an upsert or deletion rewrites the buckets it touches, and nothing is fitted in either.

The product of a query with a code is the query's product with the centre plus a number for each part, from a table of 256 a part that is made
once a query. As all vectors have length 1, it is within the stored distance of the true cosine. So a search of all lists may be exact: codes give the
k-th best lower bound of each query, then the vectors that reach the bound of any query, and those are compared with all queries where they lie. What is
shuffled are k rows of each query and task and an id of each vector, however loose the bounds are.

Filters and the list of allowed ids come before the top k. Null ids and embeddings are not stored, zero vectors have cosines of 0, and of
an id's vectors in one call the greatest counts. An index whose vectors are all deleted has no answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.shared import settled
from corvane.functions.vectors import cosine
from corvane.operators import ann
from corvane.operators.vector import NEAREST, Bests, batch_top_k, query_blocks, query_parts, unit_rows, vector_blocks
from corvane.sources.buckets import BUCKET, BucketTable
from corvane.sources.folders import Folder

#: Queries up to which tables are quicker than codes that are turned back into vectors.
FEW = 12


class Model:
    """List centres (unit vectors) and the values of each part."""

    def __init__(self, centres: np.ndarray, values: list[np.ndarray]):
        self.centres, self.values = centres, values
        self.edges = np.cumsum([0] + [v.shape[1] for v in values])

    @classmethod
    def fit(cls, vectors: DataFrame, lists: int, parts: int, id_col: str, embedding: str, sample: int, rounds: int = 12, seed: int = 3) -> Model:
        """From at most `sample` vectors, those with the smallest hashes of their ids."""
        rows = vectors.select(F.col(id_col).alias("i"), F.col(embedding).cast("array<double>").alias("e")).filter("e is not null").orderBy(F.xxhash64("i"), "i").limit(sample).collect()
        if not rows:
            raise ValueError("an index is fitted on one vector at least")
        x = unit_rows(np.array([r["e"] for r in rows], np.float64))
        centres = ann.spherical(x, lists, rounds, seed)
        rest = x - centres[(x @ centres.T).argmax(1)]
        rng = np.random.default_rng(seed)
        return cls(centres, [_means(part, 256, rounds, rng) for part in np.array_split(rest, min(parts, x.shape[1]), axis=1)])

    def encode(self, embeddings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and the code's distance of each vector."""
        x = unit_rows(embeddings.astype(np.float64))
        lists = (x @ self.centres.T).argmax(1)
        rest = x - self.centres[lists]
        codes = np.stack([_nearest(rest[:, a:b], v) for a, b, v in zip(self.edges, self.edges[1:], self.values, strict=False)], axis=1).astype(np.uint8)
        return lists.astype(np.int32), codes, np.linalg.norm(x - self.decode(lists, codes), axis=1)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[lists] + np.concatenate([v[codes[:, j]] for j, v in enumerate(self.values)], axis=1)

    def products(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """A row for each query, a column for each code of the list `at`."""
        if len(queries) > FEW:
            return queries @ self.decode(np.full(len(codes), at), codes).T
        out = np.repeat((queries @ self.centres[at])[:, None], len(codes), axis=1)
        for j, v in enumerate(self.values):
            out += (queries[:, self.edges[j] : self.edges[j + 1]] @ v.T)[:, codes[:, j]]
        return out


def _nearest(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return ((v * v).sum(1)[None] - 2 * x @ v.T).argmin(1)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    v = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, v)
        sums, n = np.zeros_like(v), np.bincount(own, minlength=len(v))
        np.add.at(sums, own, x)
        v[n > 0] = sums[n > 0] / n[n > 0, None]
    return v


class StoredIndex:
    def __init__(self, spark: SparkSession, path: str):
        """Opens the index of a folder; build() makes one."""
        self.spark, self.path = spark, path.rstrip("/")
        self.codes, self.vectors = BucketTable(spark, f"{self.path}/codes"), BucketTable(spark, f"{self.path}/vectors")
        self.attributes = [f.name for f in self.codes.schema if f.name not in ("id", "list", "code", "error")]
        rows = spark.read.parquet(f"{self.path}/model").orderBy("n").collect()
        arrays = [np.frombuffer(bytes(r["data"]), np.float64).reshape(r["rows"], -1) for r in rows]
        self.model = Model(arrays[0], arrays[1:])

    @classmethod
    def there(cls, spark: SparkSession, path: str) -> bool:
        return Folder(spark, path).exists("vectors/manifests")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int = 64, parts: int = 16, attributes: tuple[str, ...] = (), id_col: str = "vec_id", embedding: str = "embedding", sample: int = 20_000, buckets: int = 64) -> StoredIndex:
        """Fits the model and stores all vectors. attributes: columns that filters may name."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        Folder(spark, path).delete()
        model = Model.fit(vectors, lists, parts, id_col, embedding, sample)
        arrays = [np.ascontiguousarray(a, np.float64) for a in (model.centres, *model.values)]
        spark.createDataFrame([(n, len(a), bytearray(a.tobytes())) for n, a in enumerate(arrays)], "n int, rows int, data binary").coalesce(1).write.parquet(f"{path}/model")
        kinds = "".join(f", `{a}` {vectors.schema[a].dataType.simpleString()}" for a in attributes)
        n = len(model.centres)
        BucketTable(spark, f"{path}/codes", f"id long, list int, code binary, error float{kinds}", ["id"], n, f"list % {n}")
        BucketTable(spark, f"{path}/vectors", "id long, list int, embedding array<float>", ["id"], buckets)
        index = cls(spark, path)
        index.upsert(vectors, id_col, embedding)
        return index

    def upsert(self, rows: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", writer: tuple[str, int] | None = None) -> None:
        """Vectors take the place of those with their ids. Codes change before vectors, whose lists tell where an id's code is."""
        kinds = "".join(f", `{a}` {self.codes.schema[a].dataType.simpleString()}" for a in self.attributes)
        own = rows.filter(F.col(embedding).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("embedding"), *(F.col(a).cast(self.codes.schema[a].dataType) for a in self.attributes))
        sent = self.spark.sparkContext.broadcast(self.model)
        names = ["id", "list", "code", "error", "embedding", *self.attributes]

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in vector_blocks(batches):
                lists, codes, error = sent.value.encode(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1))
                error = np.nextafter(error.astype(np.float32) + np.float32(1e-6), np.float32(9))  # of products in doubles, and of similarities' six places
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), *b.columns[1:]], names=names)

        rest = ["embedding", *self.attributes]
        once = own.groupBy("id").agg(F.max(F.struct(*rest)).alias("r")).select("id", "r.*")
        new = settled(once.mapInArrow(encode, f"id long, list int, code binary, error float, embedding array<float>{kinds}"))
        was = settled(self.vectors.lookup(new).select("id", "list"))
        of = self.codes.bucket_of().alias(BUCKET)
        add = new.select(*self.codes.schema.names, of)
        self.codes.rewrite(add, was.select("id", of).unionByName(add.select("id", BUCKET)), writer=writer)
        self.vectors.upsert(new.select("id", "list", "embedding"), writer=writer)

    def delete(self, ids: DataFrame, writer: tuple[str, int] | None = None) -> None:
        """ids: a column id. Their buckets alone are rewritten."""
        was = settled(self.vectors.lookup(ids).select("id", "list"))
        none = self.codes.read().limit(0).withColumn(BUCKET, F.lit(0))
        self.codes.rewrite(none, was.select("id", self.codes.bucket_of().alias(BUCKET)), writer=writer)
        self.vectors.delete(was, writer)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, where: Column | str | None = None, allowed: DataFrame | None = None, over: int = 4, exact: bool = False, query_id: str = "query_id", embedding: str = "embedding") -> DataFrame:
        """query_id, id, similarity, rank of the k nearest of each query.

        probes: lists that a query looks into, all if none is given. where: a filter on attributes and id. allowed: ids that may be answers.
        The best `over` times k by codes are compared in full, with exact, which probes all lists, whatever may be among the k nearest.
        """
        if exact:
            return self._exact(queries, k, where, allowed, query_id, embedding)
        manifest = self.codes.manifest()
        parts = []
        for sent in query_blocks(self.spark, queries, query_id, embedding):
            keys, matrix = sent.value
            n = len(self.model.centres) if probes is None else probes
            nearest = np.argsort(-(matrix @ self.model.centres.T), axis=1, kind="stable")[:, :n] if len(keys) else np.zeros((0, 0), np.int64)
            asks = {int(a): np.flatnonzero((nearest == a).any(1)) for a in np.unique(nearest)}
            run = _best(sent, self.spark.sparkContext.broadcast((self.model, asks)), over * k)
            parts.append(_kept(self.codes._read(manifest, asks), where, allowed).mapInArrow(run, NEAREST))
        by = Window.partitionBy("query_id")
        near = reduce(DataFrame.unionAll, parts).withColumn("n", F.row_number().over(by.orderBy(F.desc("similarity"), "id"))).filter(F.col("n") <= over * k)
        near = settled(near.select("query_id", "id"))
        asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(embedding).alias("_q"))
        full = near.join(self.vectors.lookup(near.select("id")).select("id", "embedding"), "id").join(asked, "query_id").withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("_q")), 6))
        w = by.orderBy(F.desc("similarity"), "id")
        return full.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "id", "similarity", "rank")

    def _exact(self, queries: DataFrame, k: int, where: Column | str | None, allowed: DataFrame | None, query_id: str, embedding: str) -> DataFrame:
        """The k-th lower bounds come to the driver, a number for each query of a block."""
        rows = settled(_kept(self.codes.read(), where, allowed))
        by = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        parts = []
        for sent in query_blocks(self.spark, queries, query_id, embedding):
            keys = sent.value[0]
            asks = dict.fromkeys(range(len(self.model.centres)), np.arange(len(keys)))
            low = rows.mapInArrow(_best(sent, self.spark.sparkContext.broadcast((self.model, asks)), k, lower=True), NEAREST)
            least = {r[0]: r[1] for r in low.withColumn("n", F.row_number().over(by)).filter(F.col("n") == k).select("query_id", "similarity").toLocalIterator()}
            bound = np.array([least.get(q, -np.inf) for q in keys.tolist()])
            parts.append(rows.mapInArrow(_reaching(sent, self.spark.sparkContext.broadcast((self.model, bound))), "id long"))
        found = self.vectors.lookup(settled(reduce(DataFrame.unionAll, parts)))
        return batch_top_k(found, queries, k, "id", "embedding", query_id, embedding)

    def bytes_of(self, lists: list[int] | None = None) -> int:
        """Bytes of the stored codes of some lists."""
        parts = self.codes.manifest()["parts"]
        own = parts if lists is None else {str(n): parts[str(n)] for n in lists if str(n) in parts}
        return sum(self.codes.folder.size(p) for ps in own.values() for p in ps)


def _kept(codes: DataFrame, where: Column | str | None, allowed: DataFrame | None) -> DataFrame:
    """list, id, code, error of the codes that may be answers."""
    rows = codes if where is None else codes.filter(where)
    rows = rows if allowed is None else rows.join(allowed.select(F.col("id").cast("long")).distinct(), "id", "left_semi")
    return rows.select("list", "id", "code", "error")


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """list, ids, codes and errors of each block's rows of a list."""
    for b in vector_blocks(batches):
        lists, ids, errors = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy().astype(np.float64)
        codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
        for n in np.unique(lists).tolist():
            rows = lists == n
            yield n, ids[rows], codes[rows], errors[rows]


def _best(sent: Broadcast, shared: Broadcast, k: int, lower: bool = False):
    """A task's k best of each query by code, or by the lower bound, among the lists that it looks into. Nine places, far inside of what bounds leave for
    the similarities' six, make equal codes equal in any block, so that of copies those with the smallest ids are looked at in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, matrix = sent.value
        model, asks = shared.value
        best = Bests(keys, k)
        for n, ids, codes, errors in _coded(batches):
            off = errors if lower else 0.0
            best.add(asks[n], ids, lambda q: np.subtract(p := model.products(matrix[q], n, codes), off, out=p), 9)  # noqa: B023
        yield from best.batches()

    return run


def _reaching(sent: Broadcast, shared: Broadcast):
    """The ids whose upper bound reaches the bound of any query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, matrix = sent.value
        model, bound = shared.value
        for n, ids, codes, errors in _coded(batches):
            rest = np.arange(len(ids))
            for q in query_parts(np.arange(len(keys))):
                if len(rest):
                    high = model.products(matrix[q], n, codes[rest]) + errors[rest]
                    rest = rest[(high < bound[q][:, None]).all(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.delete(ids, rest))], names=["id"])

    return run
