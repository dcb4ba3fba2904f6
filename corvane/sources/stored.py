"""Stored chunks and graphs: tables in buckets, so that an upsert costs what it touches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.shared import settled
from corvane.operators import graph
from corvane.sources.buckets import BucketTable
from corvane.sources.folders import Folder

NODES, EDGES = "id string, label string, properties map<string,string>", "src_id string, dst_id string, relationship string"


class GraphStore:
    """Nodes by id, and each edge twice, by either end: so what stands at a node is found, and taken out, in the buckets of its id.

    The tables change one after another. A write that broke off is run again with its writer's name and number, and makes up for what
    is missing: which edges go with their nodes is written down before any of them goes.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.folder = spark, Folder(spark, path)
        self.nodes = BucketTable(spark, f"{path}/nodes", NODES, ["id", "label"], buckets, f"pmod(xxhash64(id), {buckets})")
        keys = ["src_id", "dst_id", "relationship"]
        self.out, self.into = (BucketTable(spark, f"{path}/{name}", EDGES, keys, buckets, f"pmod(xxhash64({end}), {buckets})") for name, end in (("out", "src_id"), ("into", "dst_id")))

    def upsert_nodes(self, nodes: DataFrame, writer: tuple[str, int] | None = None) -> None:
        """The union of a node's properties, new values over old ones."""
        self.nodes.upsert(nodes, merge=graph.upsert_nodes, writer=writer)

    def upsert_edges(self, edges: DataFrame, writer: tuple[str, int] | None = None) -> None:
        """New edges whose ends are both there; each once. Nodes are read in the buckets of the ends alone."""
        new = settled(edges.select("src_id", "dst_id", "relationship").distinct())
        ends = new.select(F.col("src_id").alias("id")).union(new.select("dst_id")).distinct()
        known = graph.upsert_edges(new.limit(0), new, self.nodes_of(ends))
        self.out.upsert(known, writer=writer)
        self.into.upsert(known, writer=writer)

    def delete_nodes(self, ids: DataFrame, writer: tuple[str, int] | None = None) -> None:
        """The nodes go, and all edges at them, with nodes and edges elsewhere untouched."""
        own = settled(ids.select(F.col("id").cast("string").alias("id")).distinct())
        pending = f"pending/{writer[0]}-{writer[1]}" if writer else f"pending/{uuid.uuid4().hex}"
        if not self.folder.exists(f"{pending}/_SUCCESS"):
            self.edges_of(own).distinct().write.mode("overwrite").parquet(f"{self.folder.path}/{pending}")
        dead = self.spark.read.schema(EDGES).parquet(f"{self.folder.path}/{pending}")
        self.out.delete(dead, writer)
        self.into.delete(dead, writer)
        self.nodes.delete(self.nodes_of(own), writer)
        self.folder.delete(pending)

    def nodes_of(self, ids: DataFrame) -> DataFrame:
        return _at(self.nodes, ids, "id")

    def edges_of(self, ids: DataFrame) -> DataFrame:
        """The edges that begin or end at these nodes; an edge between two of them twice."""
        return _at(self.out, ids, "src_id").unionByName(_at(self.into, ids, "dst_id"))

    def edges(self) -> DataFrame:
        return self.out.read()

    def near(self, ids: DataFrame, depth: int) -> DataFrame:
        """id, depth of the nodes within `depth` edges, either way, their starts at 0: each step reads the buckets of its frontier."""
        found = settled(ids.select(F.col("id").cast("string").alias("id"), F.lit(0).alias("depth")).distinct())
        front = found.select("id")
        for n in range(1, depth + 1):
            edges = self.edges_of(front)
            ends = edges.select(F.col("src_id").alias("id")).union(edges.select("dst_id")).distinct()
            new = settled(ends.join(found.select("id"), "id", "left_anti"))
            found, front = settled(found.union(new.withColumn("depth", F.lit(n)))), new
        return found


def _at(table: BucketTable, ids: DataFrame, column: str) -> DataFrame:
    """A table's rows at these ids, where the id alone decides the bucket; its other buckets are not read."""
    own = ids.select(F.col("id").alias(column)).distinct()
    buckets = sorted(r[0] for r in own.select(table.bucket_of()).distinct().collect())
    return table.read(buckets=buckets).join(own, column, "left_semi")


CHUNKS = "id bigint, file_path string, source_root string, language string, line_start int, line_end int, chunk_text string, embedding array<float>, properties string, created_at timestamp, kind string"


def chunk_table(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    """Chunks by file: an upsert replaces all chunks of its files, and a file's chunks stand in one bucket."""
    return BucketTable(spark, path, CHUNKS, ["source_root", "file_path"], buckets)
