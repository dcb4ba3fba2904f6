"""WARC archives of pages, and a reader that verifies the chain of record boundaries.

Writing: of records with equal payloads the one with the smallest page_id is a response, the others are revisits that refer to
it and hold no payload. Digests that repeat are found from the digests alone. They are marked in a bitmap of BITS_EACH bits for each of them, as
far as MARKS allows; a page whose digest is not marked is written where it is read, and of the marked ones a task sends each payload once. Archives are
plain files, so that tasks can read parts of them, of at most `archive_records` records each.

Reading: tasks read byte ranges of the archives, cut at every line that begins like a record. A task emits each such place and
the place where the next record would begin by the candidate's own Content-Length, both counted from its range's first line;
the sizes of a file's ranges give the rest. Inside parts of a range, pointers are followed at once, so every candidate knows where its chain leaves the
part; pointer jumping from the start of each file then goes from part to part, twice as far each round. A candidate is reached
if the place at which the chain enters its part lies below it in the part's tree of pointers. All others, such as record heads inside
payloads, are rejected. A reached record that holds the magic itself and runs over the end of a range is put together in a second scan.

Results for edge cases: a null payload is an empty one. A null page_id is larger than all others, so it is a response
only among its like. Rows that repeat a page_id with an equal payload have the same record type. A null url is written as
`urn:x-corvane:none`, a long one whole. A payload of any length is one record. An empty table gives no record. Other columns are
not read, whatever their names. A file that is cut off ends with its last whole record; any other file whose chain stops before
its end, as at a damaged record, is an error. Files whose names end with `.gz` are read in one piece each.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import Rows, Scratch, map_arrow, rows_of

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, LINE, END = b"WARC/1.", b"\r\n", b"\r\n\r\n"
#: What separates the pieces that a task reads.
CUT = LINE + MAGIC
#: Bits that mark the digests which repeat, for each of them and at least and at most in all, powers of two: with 16 a digest that does not repeat is marked in 1 of 16 cases.
BITS_EACH, LEAST_MARKS, MARKS = 16, 1 << 20, 1 << 30
#: Candidates of a range whose pointers are followed in memory at once.
PART = 50_000


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A whole record; refers_to makes it a revisit."""
    return _record(page_id, url, payload, len(payload), payload_digest(payload), refers_to, date)


def _record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {url}')}>", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url, safe=_SAFE) if url else 'urn:x-corvane:none'}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}"] + [f"X-Page-Id: {page_id}"] * (page_id is not None)
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


_SAFE = "!#$%&'()*+,/:;=?@[]~-._"


def _bit(size: int) -> Column:
    return F.xxhash64("_digest").bitwiseAND(F.lit(size - 1))


def _marked(repeats: DataFrame, size: int) -> np.ndarray | None:
    """The bits of the digests that repeat; `size` of them come to the driver. None if there are none."""
    one = _bit(size) + 1  # these functions count from 1
    rows = repeats.groupBy(F.bitmap_bucket_number(one).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits")).collect()
    if not rows:
        return None
    width = len(rows[0]["bits"])
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        out[(r["k"] - 1) * width : r["k"] * width] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", archive_records: int = 50_000, scratch: Scratch | None = None) -> None:
    """Writes the archives into the folder path."""
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    own = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("_payload"))
    own = own.withColumn("_digest", F.unhex(F.sha1("_payload")))
    repeats = scratch.keep(own.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "repeats")
    size = min(MARKS, max(LEAST_MARKS, 1 << (BITS_EACH * repeats.count()).bit_length()))
    marks = spark.sparkContext.broadcast(_marked(repeats, size))
    own = own.withColumn("_bit", _bit(size))

    def is_marked(bits: pa.Array) -> np.ndarray:
        at, table = bits.to_numpy(), marks.value
        return np.zeros(len(at), bool) if table is None else table[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1

    def records(batches: Iterator[pa.RecordBatch], skip: bool) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("value", pa.binary())])
        for batch in batches:
            out = Rows(schema, 500)
            if skip:
                batch = batch.filter(pa.array(~is_marked(batch.column(6))))
            for i, url, payload, size, digest, refers, *_ in rows_of(batch):
                out.add(_record(i, url, payload, size, base64.b32encode(digest).decode(), refers, date)[:-2])  # the sink ends each row with the last line end
                if out.full:
                    yield out.take()
            yield out.take()

    columns = ["_id", "_url", "_payload", "_size", "_digest", "_refers"]
    sized = own.withColumn("_size", F.octet_length("_payload").cast("long"))
    texts = sized.withColumn("_refers", F.lit(None).cast("long")).select(*columns, "_bit").transform(map_arrow, lambda b: records(b, True), "value binary")
    if marks.value is not None:

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(is_marked(batch.column(batch.num_columns - 1))))

        few = sized.select("_id", "_url", "_size", "_digest", "_bit").transform(map_arrow, hits, "_id long, _url string, _size long, _digest binary, _bit long")
        refers = F.when(F.coalesce(F.col("_id") != F.col("_first"), F.col("_first").isNotNull()), F.col("_first"))
        told = few.join(repeats.select("_digest", "_first"), "_digest", "left").withColumn("_refers", refers)
        once = own.select("_digest", "_payload", "_bit").transform(map_arrow, hits, "_digest binary, _payload binary, _bit long").groupBy("_digest").agg(F.any_value("_payload").alias("_payload"))
        first = told.filter("_refers is null").join(once, "_digest")
        again = told.filter("_refers is not null").withColumn("_payload", F.lit(None).cast("binary"))
        texts = texts.unionAll(first.select(*columns).unionAll(again.select(*columns)).transform(map_arrow, lambda b: records(b, False), "value binary"))
    texts.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", archive_records).text(path)
    scratch.drop(repeats)


_FIELDS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
_CANDIDATE = pa.schema([("file", pa.int64()), ("range", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), ("begin", pa.int64()), ("next", pa.int64()), ("leaves", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), *_FIELDS])
CANDIDATE = "file long, range long, part long, kind int, begin long, next long, leaves long, low long, high long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: A whole record, one whose end another task reads, a place where a file that ends at `next` is cut off, and a range with its size in `next`.
WHOLE, LONG, STOP, RANGE = 0, 1, 2, 3


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() else None


def _head(piece: bytes) -> tuple[int, int, dict[str, str]] | None:
    """Where the block of the record begins that the piece begins with, its length, and the fields; None if it is no record, length -1 if the head has no end."""
    if (version := piece[7:10]) not in (b"0\r\n", b"1\r\n"):
        return (len(piece), -1, {}) if len(piece) < 10 and b"\r\n".startswith(version[1:]) and version[:1] in (b"", b"0", b"1") else None
    end = piece.find(END)
    if end < 0:
        return len(piece), -1, {}
    fields = _fields(piece[:end])
    length = _number(fields.get("content-length"))
    return None if length is None else (end + 4, length, fields)


def _content(fields: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of a record."""
    http, _, payload = block.partition(END)
    page, refers = (int(x) if x and x.lstrip("-").isdigit() else None for x in (fields.get("x-page-id"), fields.get("x-refers-to-page-id")))
    if fields.get("warc-type") == "revisit":
        return page, _number(_fields(http).get("content-length")), fields.get("warc-payload-digest", "").removeprefix("sha1:"), "revisit", refers
    return page, len(payload), payload_digest(payload), fields.get("warc-type"), None


class Range:
    """The pieces of a byte range in their order, each with the line end and magic that it was cut at."""

    def __init__(self, first: bool, length: int | None):
        self.first, self.length, self.size = first, length, 0
        self.open: list[tuple[int, int, int, dict[str, str]]] = []  # begin, begin of the block, next, fields
        self.held: list[bytes] = []  # from the begin of the first open record on
        self.held_at = 0

    def add(self, value: bytes) -> Iterator[tuple]:
        """kind, begin, next and the record's fields of what is known after one more piece."""
        whole = self.first and not self.size
        begin, piece = (0, value) if whole else (self.size - len(MAGIC), MAGIC + value)
        self.size += len(value) + len(CUT)
        end = self.size - len(MAGIC)  # with the line end of the cut
        if self.open:
            self.held.append(MAGIC + value + LINE)
            yield from self._close(end)
        head = _head(piece) if piece.startswith(MAGIC) else (len(piece), -1, {}) if MAGIC.startswith(piece) else None
        if head is not None:
            at, length, fields = head
            if length < 0:
                yield STOP, begin, begin + len(piece), *[None] * 5
            else:
                next_ = begin + at + length + len(END)
                if next_ <= end:
                    if (piece + LINE)[at + length :][:4] == END:
                        yield WHOLE, begin, next_, *_content(fields, piece[at : at + length])
                elif self.length is not None and next_ > self.length:
                    yield LONG, begin, next_, *[None] * 5
                else:
                    if not self.open:
                        self.held, self.held_at = [piece + LINE], begin
                    self.open.append((begin, begin + at, next_, fields))
        for k in range(1, len(MAGIC)):
            if value.endswith(LINE + MAGIC[:k]):
                yield STOP, end - 2 - k, end - 2, *[None] * 5

    def _close(self, end: int) -> Iterator[tuple]:
        done = [x for x in self.open if x[2] <= end]
        if not done:
            return
        text = b"".join(self.held)
        for begin, block, next_, fields in done:
            if text[next_ - 4 - self.held_at : next_ - self.held_at] == END:
                yield WHOLE, begin, next_, *_content(fields, text[block - self.held_at : next_ - 4 - self.held_at])
        self.open = [x for x in self.open if x[2] > end]
        if self.open:
            cut = self.open[0][0] - self.held_at
            self.held, self.held_at = [text[cut:]], self.open[0][0]
        else:
            self.held = []

    def close(self) -> Iterator[tuple]:
        for begin, _, next_, _ in self.open:
            yield LONG, begin, next_, *[None] * 5
        self.open = []


def candidates(content: bytes) -> Iterator[tuple]:
    """begin, next and the record's own fields, for every place of an archive where a whole record might stand."""
    pieces, one = content.split(CUT), Range(True, None)
    found = [x for piece in pieces for x in one.add(piece)]
    return (x[1:] for x in sorted(found) if x[0] == WHOLE and x[2] <= len(content))


def _tree(begin: list[int], next_: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Where the chain of each candidate leaves the part, and numbers low and high: b's chain passes a if low[a] <= low[b] < high[a]. begin grows."""
    n, at = len(begin), {b: i for i, b in enumerate(begin)}
    up = [at.get(x, -1) for x in next_]
    size = [1] * n
    for i in range(n):
        if up[i] >= 0:
            size[up[i]] += size[i]
    leaves, low, free, roots = list(next_), [0] * n, [0] * n, 0
    for i in range(n - 1, -1, -1):
        if up[i] < 0:
            low[i], roots = roots, roots + size[i]
        else:
            leaves[i], low[i] = leaves[up[i]], free[up[i]]
            free[up[i]] += size[i]
        free[i] = low[i] + 1
    return leaves, low, [a + b for a, b in zip(low, size, strict=True)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Rows(_CANDIDATE)
    now, one, part, rows, whole = None, None, 0, [], None

    def close_part() -> None:
        rows.sort(key=lambda r: (r[1], r[0]))
        real = [r for r in rows if r[0] != STOP]
        tree = iter(zip(*_tree([r[1] for r in real], [r[2] for r in real]), strict=True))
        for r in rows:
            out.add(*now, part, *r[:3], *(next(tree) if r[0] != STOP else (None, None, None)), *r[3:])

    def close() -> None:
        if one is not None:
            rows.extend(one.close())
            close_part()
            out.add(*now, part, RANGE, 0, one.size, whole, *[None] * 7)

    for batch in batches:
        for file, start, length, size, value in rows_of(batch):
            if (file, start) != now:
                close()
                now, one, part, rows, whole = (file, start), Range(start == 0, length), 0, [], size
            rows.extend(one.add(value))
            if len(rows) >= PART:
                close_part()
                part, rows = part + 1, []
            if out.full:
                yield out.take()
    close()
    yield out.take()


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, range, length, size, value: byte ranges of the files of a folder, cut before each line that begins like a record. A number stands for the path."""
    raw = spark.read.option("lineSep", CUT.decode()).text(path)
    packed = F.col("_metadata.file_path").endswith(".gz")
    return raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.when(~packed, F.col("_metadata.file_block_length")).alias("length"), F.when(~packed, F.col("_metadata.file_size")).alias("size"), F.col("value").cast("binary").alias("value"))


def _reached(steps: DataFrame, files: DataFrame, scratch: Scratch) -> DataFrame:
    """file, begin of the places where the chains from the files' starts enter a part or end. steps: file, begin, leaves of each candidate."""
    start = files.select("file", F.lit(0).cast("long").alias("begin"))
    entry = steps.select("file", F.col("leaves").alias("begin")).union(start).distinct()
    jump = scratch.keep(steps.join(entry, ["file", "begin"], "left_semi").select("file", "begin", F.col("leaves").alias("next")), "jump")
    reached = scratch.keep(start, "reached")
    n, spent = reached.count(), [jump, reached]
    while True:
        onward = reached.join(jump, ["file", "begin"]).select("file", F.col("next").alias("begin"))
        wider = scratch.keep(reached.union(onward).distinct(), "reached")
        now = wider.count()
        if now == n:
            scratch.drop(*spent)
            return wider
        twice = jump.select("file", F.col("begin").alias("next"), F.col("next").alias("end"))
        further = scratch.keep(jump.join(twice, ["file", "next"]).select("file", "begin", F.col("end").alias("next")), "jump")
        scratch.drop(*spent)
        reached, jump, n, spent = wider, further, now, [wider, further]


def _long(spark: SparkSession, path: str, cut: DataFrame, ranges: DataFrame, scratch: Scratch) -> DataFrame:
    """The fields of reached records that run over the ends of ranges: file, begin and _FIELDS. The ranges that hold their pieces are read again."""
    places = ranges.select("file", "base", "range", F.lit(None).cast("struct<begin:bigint,next:bigint>").alias("of")).unionAll(cut.select("file", F.col("begin").alias("base"), F.lit(None).cast("long").alias("range"), F.struct("begin", "next").alias("of")))
    before = F.last("of", ignorenulls=True).over(Window.partitionBy("file").orderBy("base", F.col("of").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a row for each range of a file
    covered = places.withColumn("c", before).filter("range is not null and c.next > base").select("file", "range", "base", "c.begin", "c.next")
    need = scratch.keep(covered.unionAll(cut.select("file", "range", "base", "begin", "next")).distinct(), "need")
    kind = "file long, range long, at long, value binary"

    def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size = None, 0
        for batch in batches:
            at = []
            for file, start, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (file, start) != now:
                    now, size = (file, start), 0
                at.append(size)
                size += len(value.as_buffer()) + len(CUT)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64()), batch.column(2)], names=["file", "range", "at", "value"])

    rows = _pieces(spark, path).select("file", "range", "value").transform(map_arrow, places_of, kind).join(need, ["file", "range"])
    at = F.col("base") + F.col("at")
    own = rows.withColumn("at", at).filter("at >= begin and at < next")
    texts = own.groupBy("file", "begin", "next").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("pieces"))
    schema = pa.schema([("file", pa.int64()), ("begin", pa.int64()), *_FIELDS])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema, 100)
        for batch in batches:
            for file, begin, next_, pieces in rows_of(batch):
                text = CUT.join(p["value"] for p in pieces) + LINE
                text = (text if pieces[0]["at"] == begin else MAGIC + text)[: next_ - begin]
                at, length, fields = _head(text)
                if text[at + length :] != END:
                    raise ValueError(f"a record at {begin} of an archive does not end where its head says")
                out.add(file, begin, *_content(fields, text[at : at + length]))
                if out.full:
                    yield out.take()
        yield out.take()

    return texts.transform(map_arrow, join, "file long, begin long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_archives(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """The records that the chain from the start of each file reaches; an error where one ends before its file does."""
    pieces = _pieces(spark, path).select("file", "range", "length", "size", "value")
    found = scratch.keep(pieces.transform(map_arrow, _scan, CANDIDATE), "candidates")
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a file
    ranges = scratch.keep(found.filter(F.col("kind") == RANGE).select("file", "range", F.col("next").alias("own"), F.coalesce(F.sum("next").over(before), F.lit(0)).alias("base"), F.col("leaves").alias("size")), "ranges")
    files = scratch.keep(ranges.groupBy("file").agg((F.sum("own") - len(CUT)).alias("total"), F.max("size").alias("size")).select("file", "total", F.coalesce("size", "total").alias("end")), "files")
    placed = found.filter(F.col("kind") != RANGE).join(ranges.select("file", "range", "base"), ["file", "range"])
    placed = placed.withColumns({c: F.col(c) + F.col("base") for c in ("begin", "next", "leaves")})
    records = placed.filter(F.col("kind") != STOP)
    reached = _reached(records.select("file", "begin", "leaves"), files.select("file"), scratch)

    # A chain may end with its file, in a record that the file's end cuts off, or just behind a magic there.
    ended = reached.join(files, "file").filter("begin >= end or begin = total + 2").select("file")
    cut_off = placed.filter(F.col("kind") == STOP).join(files, "file").filter("next = end").join(reached, ["file", "begin"], "left_semi").select("file")
    broken = files.join(ended.union(cut_off), "file", "left_anti").count()
    if broken:
        raise ValueError(f"{broken} archives in {path} hold something that is no record before their end")

    entry = records.join(reached, ["file", "begin"], "left_semi").select("file", "range", "part", F.col("low").alias("at"))
    passed = records.join(entry, ["file", "range", "part"]).filter("low <= at and at < high").join(files.select("file", "end"), "file").filter("next <= end")
    names = [n for n, _ in _FIELDS]
    if found.filter(F.col("kind") == LONG).limit(1).count() == 0:
        return passed.select(names)
    cut = scratch.keep(passed.filter(F.col("kind") == LONG).select("file", "range", "base", "begin", "next"), "long")
    return passed.filter(F.col("kind") == WHOLE).select(names).unionAll(_long(spark, path, cut, ranges, scratch).select(names))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_records: int = 50_000) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = scratch.path("archives")
    write_archives(pages, path, id_col, url_col, payload_col, archive_records=archive_records, scratch=scratch)
    return read_archives(pages.sparkSession, path, scratch).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) || '00' AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
      ((instr('0123456789abcdef', substr(h, CAST(1 + (5 * i) // 4 AS BIGINT), 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, CAST(2 + (5 * i) // 4 AS BIGINT), 1)) - 1)
      // (CASE (5 * i) % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END)) % 32) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
