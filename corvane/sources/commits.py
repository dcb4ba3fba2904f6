"""Sinks that a batch may be written to again: each batch has a folder of its own, and a list of commits says which folders count."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corvane.sources.folders import Folder

#: Commits in files of their own before they are put together in one.
GATHER = 100


class BatchSink:
    """Rows as JSON lines, partitioned by a column if one is given.

    A batch is written into a new folder; then a file named after its stream and number is put in place at once and names that folder. What
    was written before it, or by a run that was killed, is not in the list and is not read. A batch without rows is a commit without a folder.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, partition: str | None = None):
        self.spark, self.path, self.folder, self.partition = spark, path.rstrip("/"), Folder(spark, path), partition
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def write(self, rows: DataFrame, stream: str, batch: int) -> int:
        """Replaces the batch's rows; how many they are now."""
        name, at = f"{stream}-{batch:012d}", f"data/corvane_run={stream}-{batch:012d}-{uuid.uuid4().hex[:8]}"
        old = self._listed().get(name)
        w = rows.select(*self.schema.names).write
        (w.partitionBy(self.partition) if self.partition else w).json(f"{self.path}/{at}")
        n = self.spark.read.schema(self.schema).json(f"{self.path}/{at}").count()
        self.folder.write_json(f"commits/{name}.json", {name: at if n else None}, replace=True)
        for gone in filter(None, (old, None if n else at)):
            self.folder.delete(gone)
        if len(self.folder.names("commits")) > GATHER:
            self._gather()
        return n

    def _listed(self) -> dict[str, str | None]:
        """The folder of each batch. A batch's own file counts before the gathered list."""
        names = [n for n in self.folder.names("commits") if n.endswith(".json") and not n.startswith(".")]
        found: dict[str, str | None] = {}
        for n in sorted(names, key=lambda n: n != "all.json"):
            found |= self.folder.read_json(f"commits/{n}")
        return found

    def _gather(self) -> None:
        found = self._listed()
        names = [n for n in self.folder.names("commits") if n.endswith(".json") and n != "all.json" and not n.startswith(".")]
        self.folder.write_json("commits/all.json", found, replace=True)
        for n in names:
            self.folder.delete(f"commits/{n}")

    def read(self) -> DataFrame:
        """The rows of all batches that were committed."""
        paths = [f"{self.path}/{at}" for at in self._listed().values() if at]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").json(paths).select(*self.schema.names)

    def batches(self, stream: str) -> list[int]:
        return sorted(int(n.rpartition("-")[2]) for n in self._listed() if n.rpartition("-")[0] == stream)
