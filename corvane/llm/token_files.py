"""Token files: the ids of all documents as one array, cut into files whose document boundaries are Elias-Fano sequences.

A file holds whole documents, a range of the order by doc_id. Its parts are

    head       magic, then numbers of 8 bytes: documents, of those without an id, ids, first document, first id, bytes of an id, least doc_id
    ids        the documents' ids one after another, of 2 bytes where the vocabulary allows it, else of 4
    ends       Elias-Fano: where each document ends, counted in ids from the file's first
    doc_ids    Elias-Fano: the ids of documents above the least; documents without an id come first and are not in it
    line end   one byte

all little-endian. An Elias-Fano sequence of n numbers up to u keeps floor(log2(u / n)) low bits of each as they are and the rest as
gaps in a bit vector, two bits a number or less; every 256th set bit has its place in a table of 4 bytes. So start(k) is a select: it
reads one place, a few bytes of the vector and one low part, and there is no table of offsets.

Writing: ranges are found from the keys of documents (id, hash of the text, and a salt, so that rows that are alike are split over ranges
like others). A document is encoded once, dealt to its range, compressed, and kept there in order with its number, so what stands before a
range is known when files are written, and heads count over all of them. Tasks write files of `file_ids` ids; one longer document is a file of its own.

Results for edge cases: a null or empty text is the end id alone. Rows without an id come first; rows that share an id are ordered by
the hash of their texts. Rows that repeat are written as often as they stand there. A text of any length is one document. An empty
table gives no files and an empty result. Other columns are not read, whatever their names. A file that is cut off is an error.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Rows, Scratch, id_and_text, map_arrow, rows_of
from corvane.llm.packed import MOST_PARTITIONS
from corvane.llm.packing import WordTokenizer, encoded

MAGIC = b"corvane1"
_HEAD = struct.Struct("<8s6Qq")
_SEQUENCE = struct.Struct("<QQB")
#: Set bits from one kept place to the next.
EVERY = 256
#: Numbers whose low bits are packed at once, a multiple of 8.
_CHUNK = 1 << 16
#: Ids of a file, unless one document has more, and bytes of text for an id, about.
FILE_IDS, ID_BYTES = 16_000_000, 3


class EliasFano:
    """A sequence of growing whole numbers, read from its bytes."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        self.n, self.most, self.low_bits = _SEQUENCE.unpack_from(data)
        sizes = self.sizes(self.n, self.most, self.low_bits)
        at = np.cumsum([_SEQUENCE.size, *sizes]).tolist()
        if len(data) < at[-1]:
            raise ValueError("a sequence is cut off")
        self.low, self.high = (np.frombuffer(data[a:b], np.uint8) for a, b in zip(at[:2], at[1:3], strict=True))
        self.places = np.frombuffer(data[at[2] : at[3]], "<u4")
        self.size = at[-1]

    @staticmethod
    def sizes(n: int, most: int, low_bits: int) -> tuple[int, int, int]:
        """Bytes of the low parts, of the bit vector and of the places."""
        return (n * low_bits + 7) // 8, (n + (most >> low_bits) + 8) // 8 if n else 0, 4 * -(-n // EVERY)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.ascontiguousarray(values, np.uint64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (most // n).bit_length() - 1) if n else 0
        if not n:
            return _SEQUENCE.pack(0, 0, 0)
        low = []
        for at in range(0, n if low_bits else 0, _CHUNK):
            bits = values[at : at + _CHUNK, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)
            low.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
        set_at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(8 * EliasFano.sizes(n, most, low_bits)[1], np.uint8)
        high[set_at] = 1
        return b"".join([_SEQUENCE.pack(n, most, low_bits), *low, np.packbits(high, bitorder="little").tobytes(), set_at[::EVERY].astype("<u4").tobytes()])

    def select(self, k: int) -> int:
        """Where the k-th set bit of the vector is, from 0."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at, left = int(self.places[k // EVERY]), k % EVERY
        byte, skip, width = at >> 3, at & 7, EVERY // 4
        while True:
            bits = np.unpackbits(self.high[byte : byte + width], bitorder="little")
            bits[:skip] = 0
            found = np.flatnonzero(bits)
            if left < len(found):
                return 8 * byte + int(found[left])
            byte, skip, width, left = byte + width, 0, 2 * width, left - len(found)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k: int) -> int:
        high = self.select(k) - k
        at = k * self.low_bits
        low = int.from_bytes(self.low[at >> 3 : at + self.low_bits + 7 >> 3].tobytes(), "little") >> (at & 7) & (1 << self.low_bits) - 1
        return high << self.low_bits | low

    def values(self) -> np.ndarray:
        """All numbers."""
        high = (np.flatnonzero(np.unpackbits(self.high, bitorder="little")) - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        for at in range(0, self.n if self.low_bits else 0, _CHUNK):
            k = min(_CHUNK, self.n - at)
            bits = np.unpackbits(self.low[at * self.low_bits // 8 :][: (k * self.low_bits + 7) // 8], bitorder="little")[: k * self.low_bits]
            high[at : at + k] |= (bits.reshape(k, self.low_bits) * weights).sum(axis=1, dtype=np.uint64)
        return high


class TokenFile:
    """One file, from its bytes or a mapping of them: documents by number, or by id."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        if len(data) < _HEAD.size or bytes(data[:8]) != MAGIC:
            raise ValueError("this is no token file")
        _, self.n, self.without_id, self.n_ids, self.first_document, self.first_id, width, self.least = _HEAD.unpack_from(data)
        at = _HEAD.size + width * self.n_ids
        if len(data) < at:
            raise ValueError("a token file is cut off")
        self.ids = np.frombuffer(data[_HEAD.size : at], f"<u{width}")
        self.ends = EliasFano(data[at:])
        self.doc_ids = EliasFano(data[at + self.ends.size :])
        if len(data) != at + self.ends.size + self.doc_ids.size + 1:
            raise ValueError("a token file is cut off")

    def start(self, k: int) -> int:
        """Where the ids of document k begin, among the file's."""
        return self.ends[k - 1] if k else 0

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.start(k) : self.ends[k]]

    def doc_id(self, k: int) -> int | None:
        return None if k < self.without_id else self.least + self.doc_ids[k - self.without_id]

    def find(self, doc_id: int) -> int | None:
        """The number of the first document of that id."""
        lo, hi = 0, len(self.doc_ids)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.least + self.doc_ids[mid] < doc_id:
                lo = mid + 1
            else:
                hi = mid
        return lo + self.without_id if lo < len(self.doc_ids) and self.least + self.doc_ids[lo] == doc_id else None


def token_file(doc_ids: list[int | None], lengths: list[int], ids: list[bytes], width: int, first_document: int, first_id: int) -> bytes:
    """A file but for its line end. ids: of each document, `width` bytes an id; doc_ids grow, those that are None come first."""
    known = [i for i in doc_ids if i is not None]
    least = known[0] if known else 0
    ends = np.cumsum(np.array(lengths, np.uint64))
    above = np.array([i - least for i in known], np.uint64)
    head = _HEAD.pack(MAGIC, len(doc_ids), len(doc_ids) - len(known), int(ends[-1]), first_document, first_id, width, least)
    return b"".join([head, *ids, EliasFano.encode(ends), EliasFano.encode(above)])


#: The order of documents in files: those without an id first, those of one id by their texts' hashes. The last parts rows that are alike.
ORDER = ["has_id", "doc_id", "text_hash", "salt"]
SALTS = 1_024


def _width(model: WordTokenizer) -> int:
    return 2 if model.size <= 1 << 16 else 4


def _bounds(keys: DataFrame, n: int) -> list[tuple]:
    """The least key of each of about n ranges of ORDER, but the first's. At most MOST_PARTITIONS rows come to the driver."""
    salted = keys.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    ranges = salted.repartitionByRange(n, *ORDER).groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct(ORDER)).alias("least"))
    return [tuple(r["least"]) for r in ranges.orderBy("range").collect()][1:]


def _numbered(dealt: DataFrame) -> DataFrame:
    """range, document, first, has_id, doc_id, n, ids of sorted ranges; document and first id count from the range's begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, document, first = None, 0, 0
        for b in batches:
            ranges, n = b.column(0).to_numpy(), b.column(3).to_numpy()
            documents, firsts = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for at, end in zip(*(lambda e: (e[:-1], e[1:]))(np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1], [True]])).tolist()), strict=True):
                if ranges[at] != now:
                    now, document, first = ranges[at], 0, 0
                documents[at:end] = document + np.arange(end - at)
                firsts[at:end] = first + np.cumsum(n[at:end]) - n[at:end]
                document, first = document + end - at, first + int(n[at:end].sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(documents), pa.array(firsts), *b.columns[1:]], names=["range", "document", "first", "has_id", "doc_id", "n", "ids"])

    return dealt.select("range", "has_id", "doc_id", "n", "ids").transform(map_arrow, run, "range int, document long, first long, has_id int, doc_id long, n long, ids binary")


def _tokens(docs: DataFrame, bounds: list[tuple], tokenizer: str, end_id: int) -> DataFrame:
    """range, ORDER, n and the compressed ids of each document."""
    schema = pa.schema([("range", pa.int32()), ("has_id", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("salt", pa.int32()), ("n", pa.int64()), ("ids", pa.binary())])
    shared, end = docs.sparkSession.sparkContext.broadcast(bounds), struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, local, held, out, squeeze = WordTokenizer(tokenizer), 0, 0, Rows(schema, 5_000), zstandard.ZstdCompressor(level=1)
        kind, least = f"<u{_width(model)}", shared.value
        for batch in batches:
            texts = pa.RecordBatch.from_arrays(batch.columns[:2], names=["id", "text"])
            for (i, ids), h in zip(encoded(texts, model), batch.column(2).to_pylist(), strict=True):
                key = int(i is not None), i or 0, h, local % SALTS
                own = squeeze.compress(np.frombuffer(ids + end, "<u4").astype(kind).tobytes())
                out.add(bisect_right(least, key), *key, len(ids) // 4 + 1, own)
                local, held = local + 1, held + len(own)
                if out.full or held > 4 << 20:
                    yield out.take()
                    held = 0
        yield out.take()

    return docs.transform(map_arrow, run, "range int, has_id int, doc_id long, text_hash long, salt int, n long, ids binary")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> None:
    """Writes the documents' files into the folder path; their order is that of first_document in their heads. docs are read twice, once for their keys."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "tokens")
    own = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64(F.coalesce("_text", F.lit(b""))))
    keys = scratch.keep(own.select(F.col("_id").isNotNull().cast("int").alias("has_id"), F.coalesce("_id", F.lit(0)).alias("doc_id"), "text_hash", F.octet_length("_text").alias("bytes")), "keys")
    volume = keys.agg(F.sum("bytes")).first()[0] or 0
    n = min(MOST_PARTITIONS, max(volume // (ID_BYTES * file_ids) + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bounds = _bounds(keys.drop("bytes"), n)
    dealt = _tokens(own, bounds, tokenizer, end_id).repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", *ORDER)
    tokens = scratch.keep(_numbered(dealt), "tokens", "none")
    before = np.zeros((len(bounds) + 2, 2), np.int64)
    for r in tokens.groupBy("range").agg(F.count("*").alias("docs"), F.sum("n").alias("ids")).collect():  # n rows
        before[r["range"] + 1] = r["docs"], r["ids"]
    found = spark.sparkContext.broadcast(np.cumsum(before, axis=0))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range's rows come in their order; where others come between, as in a task of several parts of ranges, a file ends."""
        width, held, follows, expand = _width(WordTokenizer(tokenizer)), 0, None, zstandard.ZstdDecompressor()
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        ids: list[bytes] = []
        start = (0, 0)

        def close() -> Iterator[pa.RecordBatch]:
            if doc_ids:
                yield pa.RecordBatch.from_arrays([pa.array([token_file(doc_ids, lengths, ids, width, *start)], pa.binary())], names=["value"])
            for x in (doc_ids, lengths, ids):
                x.clear()

        for batch in batches:
            for k, document, first, has_id, doc_id, n, own in rows_of(batch):
                if (k, document) != follows or held + n > file_ids:
                    yield from close()
                    start, held = tuple((found.value[k] + (document, first)).tolist()), 0
                doc_ids.append(doc_id if has_id else None)
                lengths.append(n)
                ids.append(expand.decompress(own))
                held, follows = held + n, (k, document + 1)
        yield from close()

    files = tokens.transform(map_arrow, write, "value binary")
    files.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    scratch.drop(keys, tokens)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of a folder's files; with_ids adds its ids. A task holds a file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _documents(TokenFile(content.as_buffer()), with_ids)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.transform(map_arrow, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _documents(file: TokenFile, with_ids: bool) -> Iterator[pa.RecordBatch]:
    ends = file.ends.values().astype(np.int64)
    starts = np.append(0, ends[:-1])
    above = np.concatenate([np.zeros(file.without_id, np.uint64), file.doc_ids.values()]).astype(np.int64) + file.least
    doc_ids = pa.array(above, mask=np.arange(file.n) < file.without_id)
    for at in range(0, file.n, 1_000 if with_ids else 50_000):
        a, b = starts[at : at + 50_000], ends[at : at + 50_000]
        if with_ids:
            a, b = a[:1_000], b[:1_000]
        whole = file.ids[a[0] : b[-1]].astype("<u4")
        crc = [zlib.crc32(whole[i:j]) for i, j in zip((a - a[0]).tolist(), (b - a[0]).tolist(), strict=True)]
        columns = [doc_ids.slice(at, len(a)), pa.array(a + file.first_id), pa.array(b - a), pa.array(crc, pa.int64())]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(a, b[-1]) - a[0], pa.int32()), pa.array(whole.astype(np.int32))))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents' files to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    scratch = Scratch(docs.sparkSession, "tokens")
    path = scratch.path("files")
    write_token_files(docs, path, tokenizer, end_id, file_ids, id_col, text_col, scratch)
    return read_token_files(docs.sparkSession, path)
