"""Changes of a file tree as a data source: `spark.readStream.format("corvane_changes")`, and all its files by `spark.read`.

A trigger lists the tree (path, time, size of each file), compares it with the listing before, and opens the files that are new or changed;
the others are not opened. An offset is the number of a listing; listings are kept in a folder of their own, as Parquet, so the stream's
own log stays small. A batch that is run again compares the same two listings.

    path       of the file, relative to the root
    change     created, modified, moved or deleted; vanished where a file went between its listing and its read
    old_path   where a moved file was: one file went, one came, both of one size and time, and no others were like them
    size, modified, content (null for deleted and vanished files)

Options: `path`, the root; `listings`, a folder that belongs to one stream; `include` and `exclude`, globs with a line end between them;
`maxFilesPerTrigger`, changes of a trigger at most, the rest comes with the next ones; `partitionBytes`, of content for a task.

A listing goes through the driver, as those of Spark's own file sources do, some hundred bytes a file. Files are read by pyarrow's file systems
(local, HDFS, S3, GCS) in the tasks. Folders that no scan enters are not listed. An empty or missing tree has no files.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from corvane.functions.text import SKIPPED_DIRS, glob_regex

SCHEMA = "path string, change string, old_path string, size long, modified timestamp, content binary"
_ARROW = pa.schema([("path", pa.string()), ("change", pa.string()), ("old_path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", tz="UTC")), ("content", pa.binary())])
_LISTING = pa.schema([("path", pa.string()), ("time", pa.int64()), ("size", pa.int64())])
#: Listings that are left behind the newest.
KEPT = 2
#: Content of a record batch.
BATCH_BYTES = 8 << 20

Listing = dict[str, tuple[int, int]]


@dataclass
class Files(InputPartition):
    """What a task does: (path, change, old_path, size, time) of each file."""

    files: list[tuple[str, str, str | None, int, int]]

    def __init__(self, files):
        super().__init__(0)
        self.files = files


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
    return fs, path.rstrip("/") or "/"


def difference(old: Listing, new: Listing) -> list[tuple[str, str, str | None, int, int]]:
    """(path, change, old_path, size, time) in order of path."""
    came = {p: x for p, x in new.items() if p not in old}
    gone = {p: x for p, x in old.items() if p not in new}
    alike: dict[tuple[int, int], list[list[str]]] = {}
    for k, side in enumerate((gone, came)):
        for p, x in side.items():
            alike.setdefault(x, [[], []])[k].append(p)
    moved = {to[0]: of[0] for of, to in alike.values() if len(of) == len(to) == 1}
    left = set(moved.values())
    rows = [(p, "moved" if p in moved else "created", moved.get(p), s, t) for p, (t, s) in came.items()]
    rows += [(p, "deleted", None, s, t) for p, (t, s) in gone.items() if p not in left]
    rows += [(p, "modified", None, s, t) for p, (t, s) in new.items() if p in old and old[p] != (t, s)]
    return sorted(rows)


class Tree:
    """The files that a source selects: what its options say, and no more, so it can be sent to tasks."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.include, self.exclude = ([re.compile(_python(glob_regex(g))) for g in (options.get(k) or "").splitlines() if g] for k in ("include", "exclude"))
        self.most = int(options.get("maxfilespertrigger") or 0)
        self.bytes = int(options.get("partitionbytes") or 128 << 20)

    def selected(self, path: str) -> bool:
        return (not self.include or any(g.search(path) for g in self.include)) and not any(g.search(path) for g in self.exclude)

    def listing(self) -> Listing:
        fs, root = file_system(self.root)
        found: Listing = {}
        todo = [root]
        while todo:
            for i in fs.get_file_info(pafs.FileSelector(todo.pop(), allow_not_found=True)):
                if i.type == pafs.FileType.Directory and i.base_name not in SKIPPED_DIRS:
                    todo.append(i.path)
                elif i.type == pafs.FileType.File and self.selected(path := i.path[len(root) :].lstrip("/")):
                    found[path] = (i.mtime_ns, i.size)
        return found

    def parts(self, changes: list[tuple]) -> list[Files]:
        """Changes for each task, by the bytes that it opens."""
        out, held = [[]], 0
        for c in changes:
            if out[-1] and (held + c[3] > self.bytes or len(out[-1]) >= 10_000):
                out.append([])
                held = 0
            out[-1].append(c)
            held += c[3] if c[1] != "deleted" else 0
        return [Files(x) for x in out if x]

    def rows(self, part: Files | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # what Spark makes of no parts
            return
        fs, root = file_system(self.root)
        rows: list[tuple] = []
        held = 0
        for path, change, old, size, time in part.files:
            content = None
            if change != "deleted":
                try:
                    with fs.open_input_stream(f"{root}/{path}") as f:
                        content = f.read()
                except FileNotFoundError:
                    change = "vanished"
            rows.append((path, change, old, size, time // 1000, content))
            held += len(content or b"")
            if held > BATCH_BYTES or len(rows) >= 1_000:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _python(java: str) -> str:
    """The pattern of a glob for Python's re, which asks for flags first and has no && in sets."""
    return java.replace("\\&&", "&&")


class _All(DataSourceReader):
    def __init__(self, tree: Tree):
        self.tree = tree

    def partitions(self) -> list[Files]:
        return self.tree.parts(difference({}, self.tree.listing()))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.tree.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, tree: Tree, listings: str):
        self.tree, self.folder = tree, listings

    def _numbers(self) -> list[int]:
        fs, at = file_system(self.folder)
        return sorted(int(m[1]) for i in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if (m := re.fullmatch(r"(\d+)\.parquet", i.base_name)))

    def _load(self, n: int) -> Listing:
        if not n:
            return {}
        fs, at = file_system(self.folder)
        t = pq.read_table(f"{at}/{n:012d}.parquet", filesystem=fs)
        return dict(zip(t["path"].to_pylist(), zip(t["time"].to_pylist(), t["size"].to_pylist(), strict=True), strict=True))

    def _save(self, n: int, found: Listing) -> None:
        fs, at = file_system(self.folder)
        fs.create_dir(at, recursive=True)
        names = sorted(found)
        rows = pa.table([pa.array(names, pa.string()), pa.array([found[p][0] for p in names], pa.int64()), pa.array([found[p][1] for p in names], pa.int64())], schema=_LISTING)
        temp = f"{at}/.{uuid.uuid4().hex}"
        pq.write_table(rows, temp, filesystem=fs, compression="zstd")
        fs.move(temp, f"{at}/{n:012d}.parquet")

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        """The newest listing's number; a new one where the tree has changed since."""
        n = ([0] + self._numbers())[-1]
        old, new = self._load(n), self.tree.listing()
        if old == new:
            return {"listing": n}
        if self.tree.most and len(changes := difference(old, new)) > self.tree.most:
            step = dict(old)
            for path, change, was, *_ in changes[: self.tree.most]:
                for p in filter(None, (was, path if change == "deleted" else None)):
                    step.pop(p, None)
                if change != "deleted":
                    step[path] = new[path]
            new = step
        self._save(n + 1, new)
        return {"listing": n + 1}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.tree.parts(difference(self._load(start["listing"]), self._load(end["listing"])))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.tree.rows(partition)

    def commit(self, end: dict) -> None:
        fs, at = file_system(self.folder)
        for n in self._numbers():
            if n < end["listing"] - KEPT:
                fs.delete_file(f"{at}/{n:012d}.parquet")


class FileChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corvane_changes"

    def schema(self) -> str:
        return SCHEMA

    def _tree(self) -> Tree:
        options = {k.lower(): v for k, v in self.options.items()}
        if not options.get("path"):
            raise ValueError("corvane_changes needs a path")
        return Tree(options)

    def reader(self, schema) -> DataSourceReader:
        return _All(self._tree())

    def streamReader(self, schema) -> DataSourceStreamReader:
        listings = {k.lower(): v for k, v in self.options.items()}.get("listings")
        if not listings:
            raise ValueError("a stream of corvane_changes needs a folder for its listings")
        return _Stream(self._tree(), listings)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileChanges)
