"""Chunkers as table functions, so that SQL may cut texts: `FROM files f, LATERAL chunks(f.text, f.language) c`.

    chunks(text, language)                      ordinal, name, kind, line_start, line_end, text of each chunk of a text
    file_chunks(TABLE(files), text => 'body')   the same beside the table's own columns, whatever they are; the text's goes
    line_chunks(TABLE(lines) PARTITION BY id ORDER BY n, text => 'line')
                                                packed chunks of the lines of a partition, beside its first row's other columns

A null or blank text has no chunks. A language that has no chunker, or none, is packed by paragraphs. A column of the table that has the name of a
chunk's is an error when the query is analyzed, as is a text column that the table lacks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corvane.operators.chunking import CHUNKERS, MAX_CHARS, Chunk, pack

CHUNK = StructType([StructField(n, t) for n, t in (("ordinal", IntegerType()), ("name", StringType()), ("kind", StringType()), ("line_start", IntegerType()), ("line_end", IntegerType()), ("chunk", StringType()))])
Chunkers = dict[str, Callable[[str], list[Chunk]]]


def _cut(text: str | None, language: str | None, known: Chunkers) -> Iterator[tuple]:
    found = known[language](text or "") if language in known else []
    for n, c in enumerate(found or pack(text or "")):
        yield n, c.name, c.kind, c.line_start, c.line_end, c.text


def _beside(table: AnalyzeArgument, *gone: str) -> tuple[StructType, list[str]]:
    """The schema of a table's other columns and a chunk, and those columns' names."""
    if not table.isTable:
        raise ValueError("give a table: TABLE(name)")
    names = table.dataType.names
    if missing := [g for g in gone if g not in names]:
        raise ValueError(f"the table has no column {missing[0]}")
    own = [f for f in table.dataType if f.name not in gone]
    if clash := [f.name for f in own if f.name in CHUNK.names]:
        raise ValueError(f"the table has a column {clash[0]}, as chunks have")
    return StructType(own + list(CHUNK)), [f.name for f in own]


def _constant(argument: AnalyzeArgument | None, default):
    return default if argument is None or argument.value is None else argument.value


def functions(chunkers: Chunkers | None = None) -> dict[str, type]:
    """The table functions by name; chunkers: more languages, or others for those that are known."""
    known = {**CHUNKERS, **(chunkers or {})}

    class Chunks:
        def eval(self, text: str, language: str) -> Iterator[tuple]:
            yield from _cut(text, language, known)

    class FileChunks:
        @staticmethod
        def analyze(table: AnalyzeArgument, text: AnalyzeArgument | None = None, language: AnalyzeArgument | None = None) -> AnalyzeResult:
            name = _constant(text, "text")
            return AnalyzeResult(_beside(table, name)[0])

        def eval(self, table, text: str = "text", language: str = "language") -> Iterator[tuple]:
            row = table.asDict(recursive=False)
            rest = tuple(v for k, v in row.items() if k != text)
            for c in _cut(row[text], row.get(language), known):
                yield rest + c

    class LineChunks:
        def __init__(self):
            self.lines: list[str] = []
            self.rest: tuple | None = None
            self.most = MAX_CHARS

        @staticmethod
        def analyze(table: AnalyzeArgument, text: AnalyzeArgument | None = None, most: AnalyzeArgument | None = None) -> AnalyzeResult:
            return AnalyzeResult(_beside(table, _constant(text, "text"))[0])

        def eval(self, table, text: str = "text", most: int = MAX_CHARS) -> None:
            row = table.asDict(recursive=False)
            if self.rest is None:
                self.rest, self.most = tuple(v for k, v in row.items() if k != text), most
            if row[text] is not None:
                self.lines.append(row[text])

        def terminate(self) -> Iterator[tuple]:
            for n, c in enumerate(pack("\n".join(self.lines), self.most)):
                yield (*self.rest, n, c.name, c.kind, c.line_start, c.line_end, c.text)

    return {"chunks": udtf(Chunks, returnType=CHUNK), "file_chunks": udtf(FileChunks), "line_chunks": udtf(LineChunks)}


def register(spark: SparkSession, chunkers: Chunkers | None = None) -> None:
    for name, f in functions(chunkers).items():
        spark.udtf.register(name, f)
