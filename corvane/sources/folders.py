"""Small files of a shared folder, by the file system that Spark uses for it: written whole or not at all."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._jvm = spark, path.rstrip("/"), spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, sub: str = "") -> list[str]:
        at = self._at(sub)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def size(self, name: str = "") -> int:
        """Bytes of all files below."""
        return self._fs.getContentSummary(self._at(name)).getLength()

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def read_json(self, name: str) -> Any:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_json(self, name: str, value: Any, replace: bool) -> bool:
        """Whether it was written: without `replace`, a file of that name stays. Nobody sees half of it."""
        temp = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}".lstrip("/")
        stream = self._fs.create(self._at(temp), True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, int(replace))
        if replace:
            how[0] = kind.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._conf)
        try:
            context.rename(self._at(temp), self._at(name), how)
        except Exception:
            self.delete(temp)
            if not replace and self.exists(name):
                return False
            raise
        return True
