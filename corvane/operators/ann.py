"""Approximate search: an inverted-list index of unit vectors, and codes of a few bits. Every vector is indexed.

Centroids are fitted on the driver from at most `sample` vectors (those with the smallest hashes of their ids); the index
is a table (list, id, embedding) to be written partitioned by list, so that a search reads the probed lists alone. Codes are
a table (id, scale, codes) with two values in a byte at 4 bits; a search multiplies codes, and the best are looked at again in full.

Searches send queries to the tasks in blocks of bytes, and a task hands on its k best of each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.vectors import cosine
from corvane.operators.vector import NEAREST, Bests, batch_top_k, query_blocks, unit_rows, vector_blocks


def centroids(vectors: DataFrame, lists: int, id_col: str = "vec_id", embedding: str = "embedding", sample: int = 20_000, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """Spherical k-means on the sample."""
    rows = vectors.select(F.col(id_col).alias("i"), F.col(embedding).alias("e")).filter("e is not null").orderBy(F.xxhash64("i"), "i").limit(sample).collect()
    x = unit_rows(np.array([r["e"] for r in rows], np.float64).reshape(len(rows), -1 if rows else 1))
    return spherical(x, lists, rounds, seed) if len(x) else x


def spherical(x: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Unit vectors that k-means by cosines finds among unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(np.bincount(own, minlength=len(c))[:, None] > 0, unit_rows(sums), c)
    return c


def build(vectors: DataFrame, centres: np.ndarray, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """list, id, embedding of every vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vector_blocks(batches):
            v = b.column(1).flatten().to_numpy().astype(np.float64).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array((v @ sent.value.T).argmax(1).astype(np.int32)), b.column(0), b.column(1)], names=["list", "id", "embedding"])

    own = vectors.filter(F.col(embedding).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("embedding"))
    return own.mapInArrow(run, "list int, id long, embedding array<double>")


def search(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int, query_id: str = "query_id", embedding: str = "embedding") -> DataFrame:
    """query_id, id, similarity, rank: the k nearest of the vectors in each query's nearest lists. Lists that no query of a block probes are not read."""
    parts = []
    for sent in query_blocks(index.sparkSession, queries, query_id, embedding):
        keys, matrix = sent.value
        probed = np.argsort(-(matrix @ centres.T), axis=1, kind="stable")[:, :probes] if len(keys) and centres.size else np.zeros((len(keys), 0), np.int64)
        asks = {int(n): np.flatnonzero((probed == n).any(1)) for n in np.unique(probed)}
        own = index.filter(F.col("list").isin(list(asks))).select("list", "id", "embedding")
        parts.append(own.mapInArrow(_in_lists(sent, index.sparkSession.sparkContext.broadcast(asks), k), NEAREST))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return reduce(DataFrame.unionAll, parts).drop("tag").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _in_lists(sent: Broadcast, asks: Broadcast, k: int):
    """A task's k best of each query among the vectors of the lists that it probes; asks: the queries of each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, matrix = sent.value
        best = Bests(keys, k)
        for b in vector_blocks(batches):
            lists, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            v = unit_rows(b.column(2).flatten().to_numpy().astype(np.float64).reshape(b.num_rows, -1))
            for n in np.unique(lists).tolist():
                own = v[lists == n].T
                best.add(asks.value[n], ids[lists == n], lambda q: matrix[q] @ own, 6)  # noqa: B023
        yield from best.batches()

    return run


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact answers that were found."""
    n = exact.count()
    return found.join(exact, ["query_id", "id"], "left_semi").count() / n if n else 1.0


def quantize(embedding: Column, bits: int = 8) -> Column:
    """(scale, codes): whole numbers of `bits` bits for each value, the largest value at the end of the range."""
    top = float((1 << (bits - 1)) - 1)
    largest = F.array_max(F.transform(embedding, lambda x: F.abs(x.cast("double"))))
    scale = F.when(largest > 0, largest / top).otherwise(F.lit(1.0))
    return F.struct(scale.alias("scale"), F.transform(embedding, lambda x: F.round(x.cast("double") / scale).cast("tinyint" if bits <= 8 else "int")).alias("codes"))


def dequantize(code: Column) -> Column:
    return F.transform(code["codes"], lambda x: x.cast("double") * code["scale"])


def build_codes(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", bits: int = 4) -> DataFrame:
    """id, scale, codes (bytes; at 4 bits or less two values in each) of every vector."""
    if not 2 <= bits <= 8:
        raise ValueError("codes have 2 to 8 bits")
    top = (1 << (bits - 1)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vector_blocks(batches):
            v = b.column(1).flatten().to_numpy().astype(np.float64).reshape(b.num_rows, -1)
            largest = np.abs(v).max(1)
            scale = np.where(largest > 0, largest / top, 1.0)
            x = v / scale[:, None]
            codes = (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int8)  # half away from zero, like SQL
            rows = _packed(codes, bits)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scale), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "scale", "codes"])

    own = vectors.filter(F.col(embedding).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(embedding).alias("embedding"))
    return own.mapInArrow(run, "id long, scale double, codes binary")


def _packed(codes: np.ndarray, bits: int) -> np.ndarray:
    if bits > 4:
        return codes
    wide = np.concatenate([codes, np.zeros((len(codes), codes.shape[1] % 2), np.int8)], axis=1).astype(np.uint8) & 15
    return wide[:, ::2] | wide[:, 1::2] << 4


def _unpacked(codes: list[bytes], bits: int, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    if bits > 4:
        return x.view(np.int8)
    both = np.stack([x & 15, x >> 4], axis=2).reshape(len(codes), -1)[:, :dim].astype(np.int8)
    return np.where(both > 7, both - 16, both)


def search_codes(codes: DataFrame, queries: DataFrame, k: int, bits: int = 4, query_id: str = "query_id", embedding: str = "embedding") -> DataFrame:
    """query_id, id, similarity, rank: the k nearest by the cosine between a query and a vector's codes, over all codes. A scale changes no cosine, so it is not read."""

    def near(sent: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, matrix = sent.value
            best, every = Bests(keys, k), np.arange(len(keys))
            for b in vector_blocks(batches):
                v = unit_rows(_unpacked(b.column(1).to_pylist(), bits, matrix.shape[1]).astype(np.float64))
                best.add(every, b.column(0).to_numpy(), lambda q: matrix[q] @ v.T, 6)  # noqa: B023
            yield from best.batches()

        return run

    parts = [codes.select("id", "codes").mapInArrow(near(sent), NEAREST) for sent in query_blocks(codes.sparkSession, queries, query_id, embedding)]
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return reduce(DataFrame.unionAll, parts).drop("tag").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def backend(name: str) -> str:
    """The search strategy of a configured name."""
    known = {"exact": "exact", "lists": "lists", "quantized": "quantized"}
    if name.strip().lower() not in known:
        raise ValueError(f"no such vector backend: {name!r}")
    return known[name.strip().lower()]


def search_with(name: str, vectors: DataFrame, queries: DataFrame, k: int, lists: int = 64, probes: int = 24, bits: int = 4, over: int = 4, id_col: str = "vec_id", embedding: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """query_id, id, similarity, rank by the named strategy; codes find `over` times k, whose similarities are then computed in full."""
    kind = backend(name)
    if kind == "exact":
        return batch_top_k(vectors, queries, k, id_col, embedding, query_id)
    if kind == "lists":
        centres = centroids(vectors, lists, id_col, embedding)
        return search(build(vectors, centres, id_col, embedding), queries, centres, k, probes, query_id)
    near = search_codes(build_codes(vectors, id_col, embedding, bits), queries, over * k, bits, query_id)
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(embedding).alias("_e"))
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col("embedding").alias("_q"))
    full = near.select("query_id", "id").join(own, "id").join(asked, "query_id").withColumn("similarity", F.round(cosine(F.col("_e"), F.col("_q")), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return full.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "id", "similarity", "rank")
