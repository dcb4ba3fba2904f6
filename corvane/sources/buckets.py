"""Stored tables in buckets: an upsert rewrites the buckets that it touches, and no others.

A table is a folder of data, one subfolder for each bucket and write, and of manifests, one for each version, that say which subfolders are the
table. A write makes new subfolders and then the next manifest in one step, so readers see all of it or nothing, and those that began
before keep what they read. Of two writers at once the one that comes second looks at what the first did: where they touched different buckets
its own write stands as it is, else it is made again on the new state.

A write may carry a writer's name and a number that grows, as batches of a stream do: what a writer has done already is not done again.

The key's hash gives the bucket, or an expression of columns that the key decides. A key may have many rows; an upsert replaces them all.
Null is a key like others. An empty table has no files. Rows of one hot key are written by several tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.shared import settled
from corvane.sources.folders import Folder

BUCKET = "_bucket"
#: Versions that readers may still be at.
KEPT = 3
#: Attempts of a write beside other writers.
ATTEMPTS = 8

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    pass


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType | None = None, keys: Iterable[str] = (), buckets: int = 64, bucket: str | None = None):
        """Opens the table of a folder, or makes one there of that schema, key and number of buckets; bucket: SQL of a whole number from 0."""
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)
        if not self.versions():
            if schema is None:
                raise ValueError(f"no table in {path}")
            kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
            first = {"version": 0, "schema": kind.json(), "keys": list(keys), "buckets": buckets, "bucket": bucket, "parts": {}, "writers": {}}
            self.folder.write_json("manifests/0000000000.json", first, replace=False)
        found = self.manifest()
        self.schema = T.StructType.fromJson(json.loads(found["schema"]))
        self.keys, self.buckets, self._bucket = found["keys"], found["buckets"], found["bucket"]

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.folder.names("manifests") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, version: int | None = None) -> dict:
        return self.folder.read_json(f"manifests/{self.versions()[-1] if version is None else version:010d}.json")

    def bucket_of(self) -> Column:
        if self._bucket:
            return F.expr(self._bucket).cast("int")
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The table as of a version, the newest if none is given; of some buckets alone, others are not opened."""
        return self._read(self.manifest(version), buckets)

    def _read(self, manifest: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        parts = manifest["parts"]
        own = sorted(parts) if buckets is None else [str(b) for b in sorted(set(buckets)) if str(b) in parts]
        paths = [f"{self.path}/{p}" for b in own for p in parts[b]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of these keys; only their buckets are read. The keys are read twice."""
        own = keys.select(*self.keys).distinct()
        return _semi(self.read(version, self._touched(own.select(self.bucket_of().alias(BUCKET)))), own, self.keys, "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        """Numbers of buckets, as many as the table has at most."""
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())

    def upsert(self, rows: DataFrame, deleted: DataFrame | None = None, order: str | None = None, merge: Merge | None = None, writer: tuple[str, int] | None = None) -> int:
        """The version after it. The rows of a key take the place of that key's, keys of `deleted` lose theirs.

        order: of rows with one key only that with the largest order counts. merge: makes the new content of the touched buckets of their
        old content and the rows, instead.
        """
        own = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema))
        if order:
            rest = [f.name for f in self.schema if f.name not in self.keys]
            own = own.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("_r")).select(*self.keys, "_r.*").select(*self.schema.names)
        own = settled(own.withColumn(BUCKET, self.bucket_of()))
        gone = own.select(*self.keys, BUCKET)
        if deleted is not None:
            gone = gone.unionByName(settled(deleted.select(*self.keys).withColumn(BUCKET, self.bucket_of())))
        return self.rewrite(own, gone, merge, writer)

    def rewrite(self, add: DataFrame, gone: DataFrame, merge: Merge | None = None, writer: tuple[str, int] | None = None) -> int:
        """upsert() by parts: rows of the schema to add and keys to take out before, both with the column _bucket and safe to read again."""
        touched = self._touched(add.select(BUCKET).union(gone.select(BUCKET)))
        made: tuple[str, dict] | None = None
        for _ in range(ATTEMPTS):
            manifest = self.manifest()
            if writer and manifest["writers"].get(writer[0], -1) >= writer[1]:
                return manifest["version"]
            if not touched and not writer:
                return manifest["version"]
            was = {b: manifest["parts"].get(str(b)) for b in touched}
            if made is None or made[1] != was:
                made = self._write(manifest, add, gone, touched, merge), was
            new = {n.removeprefix(f"{BUCKET}="): [f"{made[0]}/{n}"] for n in self.folder.names(made[0]) if n.startswith(f"{BUCKET}=")} if made[0] else {}
            parts = {b: p for b, p in manifest["parts"].items() if int(b) not in was} | new
            version = manifest["version"] + 1
            writers = manifest["writers"] | ({writer[0]: writer[1]} if writer else {})
            if self.folder.write_json(f"manifests/{version:010d}.json", manifest | {"version": version, "parts": parts, "writers": writers}, replace=False):
                return version
        raise Conflict(f"{self.path}: other writers were faster {ATTEMPTS} times")

    def _write(self, manifest: dict, add: DataFrame, gone: DataFrame, touched: list[int], merge: Merge | None) -> str:
        """The subfolder with the touched buckets' new content."""
        if not touched:
            return ""
        old = self._read(manifest, touched)
        if merge:
            kept = _semi(old, gone.select(*self.keys).subtract(add.select(*self.keys)), self.keys, "left_anti")
            rows = merge(kept, add.drop(BUCKET)).select(*self.schema.names)
        else:
            rows = _semi(old, gone.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(add.drop(BUCKET))
        at = f"data/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, self.bucket_of()).hint("rebalance", BUCKET).write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.path}/{at}")
        return at

    def delete(self, keys: DataFrame, writer: tuple[str, int] | None = None) -> int:
        return self.upsert(self.spark.createDataFrame([], self.schema), keys, writer=writer)

    def done(self, writer: str) -> int:
        """The number of the writer's last write, -1 before its first."""
        return self.manifest()["writers"].get(writer, -1)

    def forget(self, kept: int = KEPT) -> None:
        """Removes manifests before the last `kept`, and data that none of those has. A write that others make meanwhile must be over first."""
        versions = self.versions()
        used = {p.split("/")[1] for v in versions[-kept:] for ps in self.manifest(v)["parts"].values() for p in ps}
        for v in versions[:-kept]:
            self.folder.delete(f"manifests/{v:010d}.json")
        for name in self.folder.names("data"):
            if name not in used:
                self.folder.delete(f"data/{name}")


def _semi(rows: DataFrame, keys: DataFrame, names: list[str], how: str) -> DataFrame:
    """A semi or anti join by keys, nulls among them."""
    right = keys.select(*(F.col(n).alias(f"_k_{n}") for n in names))
    return rows.join(right, reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"_k_{n}")) for n in names)), how)
