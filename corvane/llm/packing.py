"""Best-fit packing of tokenised documents into sequences, after Martello and Toth's dominance reduction.

A document's tokens are its ids and one end id; only documents longer than a sequence are cut. Pieces of one length are
alike, so the instance is the number of pieces of each length: at most `capacity` numbers, whatever the corpus holds. The
driver solves this instance. It fixes small sets that dominate all other sets with the same longest piece (one that nothing
fits beside, a pair that fills the sequence, the best pair or triple where no more can fit), then packs the rest best-fit
decreasing, many equal sequences at a time. Each task then finds a piece's place from its rank among pieces of its length.

Results for edge cases: a null or empty text is a document of the end id alone. A null id stays null. Repeated rows are
packed once each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import string
import struct
import sys
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import Rows, Scratch, id_and_text, map_arrow

#: Words whose ids a Python worker remembers.
WORD_CACHE = 800_000
#: Bytes of text that are encoded together, and words that the tokenizer is given at once.
GROUP_BYTES, WORDS_AT_ONCE = 8 << 20, 2_000
#: Words of small Latin-1 letters, in UTF-8: lower-casing and composing leave them as they are.
_small_letters = re.compile(rb"(?:[a-z]++|\xc3[\x9f-\xb6\xb8-\xbf])++").fullmatch
_tokenizers: dict[str, tuple] = {}
assert sys.byteorder == "little" and array("I").itemsize == 4

Pattern = tuple[list[tuple[int, int]], int]  # (length, copies) of a sequence, and how many sequences are like it


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordTokenizer:
    """Ids of a text, word by word: the tokenizer lower-cases and splits at white space, so a word's ids do not depend on its neighbours. Likewise the ASCII punctuation after a last Latin-1 letter is a run of its own.

    A group's texts are split and its distinct words numbered by Arrow, so that Python meets each of them once a group."""

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _tokenizers:
            model = Tokenizer.from_file(path)
            bare = Tokenizer(model.model)  # of a byte-level model, without the steps that leave small letters as they are
            bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            _tokenizers[path] = model, bare if "ByteLevel" in str(model.pre_tokenizer) else model, np.array([(model.id_to_token(i) or "").endswith("</w>") for i in range(model.get_vocab_size())]), {}, {}
        self.path = path
        self.model, self.bare, self.ends, self.young, self.old = _tokenizers[path]

    @property
    def size(self) -> int:
        return len(self.ends)

    def encode(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of each word. Words of letters alone are one run each, so many are encoded as one text and parted at the ids that end a run."""
        small, letters, others = [], [], []
        for w in words:
            (small if _small_letters(w) else letters if w.decode("utf-8", "replace").isalpha() else others).append(w)
        for model, own in ((self.bare, small), (self.model, letters)):
            for at in range(0, len(own), WORDS_AT_ONCE):
                part = own[at : at + WORDS_AT_ONCE]
                ids = np.array(model.encode_batch_fast([b" ".join(part).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
                last = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                if len(last) == len(part):
                    packed = ids.tobytes()
                    yield from ((w, packed[4 * i : 4 * j]) for w, i, j in zip(part, [0, *last], last, strict=False))
                else:
                    others += part
        for at in range(0, len(others), WORDS_AT_ONCE):
            part = others[at : at + WORDS_AT_ONCE]
            for w, e in zip(part, self.model.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
                yield w, array("I", e.ids).tobytes()

    def learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of different words; all are in young then. When it is full it becomes old, so words that are in use stay known."""
        if len(self.young) + len(words) > WORD_CACHE // 2:
            self.old, self.young = self.young, {}
            _tokenizers[self.path] = self.model, self.bare, self.ends, self.young, self.old
        young, old, new = self.young, self.old, []
        for w in words:
            if w not in young:
                if (known := old.get(w)) is not None:
                    young[w] = known
                else:
                    new.append(w)
        young.update(self.encode(new))
        return list(map(young.__getitem__, words))

    def ids(self, texts: list[bytes] | pa.Array) -> list[bytes]:
        """Packed ids of each text in the machine's order, which is little-endian here."""
        if not len(texts):
            return []
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())).cast(pa.large_binary()).fill_null(b"").view(pa.large_string())
        split = pc.ascii_split_whitespace(column)
        found = split.flatten()
        lower = pc.ascii_lower(found)  # not of the column: of a slice it would read other bytes
        if special := pc.any(pc.match_substring(column, "<|")).as_py():  # a special token is only found as it is written
            lower = pc.if_else(pc.match_substring(found, "<|"), found, lower)
        words = lower.dictionary_encode()
        parts = _parted(words.dictionary, special).dictionary_encode()
        at, data = _inside(parts.dictionary)
        at, data = at.tolist(), bytes(data)
        ids = self.learn([data[i:j] for i, j in zip(at, at[1:], strict=False)])
        at, data = _inside(_strings(np.cumsum([0, *map(len, ids)]), b"".join(ids)).take(parts.indices))
        at, data = _inside(_strings(at[::2], data).take(words.indices))
        at = at[split.offsets.to_numpy()].tolist()
        return [bytes(data[i:j]) for i, j in zip(at, at[1:], strict=False)]


def _inside(a: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where the strings of a large array begin and the last ends, and their bytes."""
    _, at, data = a.buffers()
    return np.frombuffer(at, np.int64)[a.offset : a.offset + len(a) + 1], memoryview(data or b"")


def _strings(at: np.ndarray, data: bytes | memoryview) -> pa.Array:
    """The array of these strings."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)])


def _parted(words: pa.Array, special: bool) -> pa.Array:
    """Of each word what stands before the ASCII punctuation at its end, then this punctuation. A word is whole, and the second part empty, where the first would not end with a Latin-1 letter."""
    at, data = _inside(words)
    size = pc.binary_length(pc.ascii_rtrim(words, string.punctuation)).to_numpy()
    end, read = at[:-1] + size, np.frombuffer(data, np.uint8)
    last, before = (read[np.where(size >= k, end - k, 0)] * (size >= k) if len(read) else np.zeros(len(size), np.uint8) for k in (1, 2))
    letter = (last | 32) - np.uint8(97) < 26
    letter |= (before == 0xC3) & (last >= 0x80) & (last | 32 != 0xB7)
    if special:
        letter &= ~pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
    edges = np.empty(2 * len(size) + 1, np.int64)
    edges[::2], edges[1::2] = at, np.where(letter, end, at[1:])
    return _strings(edges, data)


def reduce_by_dominance(count: dict[int, int], capacity: int) -> list[Pattern]:
    """Takes the sets that dominance fixes out of count; returns them."""
    fixed: list[Pattern] = []
    lengths = sorted(w for w, n in count.items() if n)

    def use(parts: list[tuple[int, int]], times: int) -> None:
        fixed.append((parts, times))
        for w, k in parts:
            count[w] -= k * times
            if not count[w]:
                lengths.pop(bisect_left(lengths, w))

    at = len(lengths)  # lengths from here on keep what is left of them
    while (at := min(at, len(lengths))) > 0:
        w = lengths[at - 1]
        n, room = count[w], capacity - w

        def others(most: int, w: int = w) -> list[int]:
            got: list[int] = []
            for x in lengths:
                got += [x] * min(count[x] - (x == w), most - len(got))
                if len(got) >= most:
                    break
            return got

        small = others(3)
        if not small or small[0] > room:
            use([(w, 1)], n)
            continue
        i = bisect_right(lengths, room) - 1
        if lengths[i] == w and n == 1:
            i -= 1
        best = lengths[i]
        pair = [(w, 2)] if best == w else [(w, 1), (best, 1)]
        times = n // 2 if best == w else min(n, count[best])
        if best == room or len(small) < 2 or small[0] + small[1] > room:
            use(pair, times)
            continue
        if len(small) < 3 or sum(small) > room:  # two more at most
            a, b = best_pair(lengths, count, w, room)
            if best >= a + b:
                use(pair, times)
                continue
            if a == best and a != w and b != w:
                k = bisect_right(lengths, b)
                above = [x for x in lengths[k : k + 3] for _ in range(min(2, count[x] - (x == w)))][:2]
                if len(above) < 2 or sum(above) > room:
                    use([(w, 1), (a, 2)] if a == b else [(w, 1), (a, 1), (b, 1)], min(n, count[a] // 2) if a == b else min(n, count[a], count[b]))
                    continue
        at -= 1
    return fixed


def best_pair(lengths: list[int], count: dict[int, int], w: int, room: int) -> tuple[int, int]:
    """The two pieces beside one of length w with the largest sum that fits; the larger first."""
    lo, hi, found = 0, bisect_right(lengths, room) - 1, (0, 0)
    free = lambda x, k: count[x] - (x == w) >= k
    while lo <= hi:
        a, b = lengths[hi], lengths[lo]
        if a + b > room or not free(a, 1):
            hi -= 1
        elif not free(b, 1) or lo == hi and not free(a, 2):
            lo += 1
        else:
            if a + b > sum(found):
                found = (a, b)
            lo += 1
    return found


def best_fit(count: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on equal pieces at a time: n pieces go to the fullest open sequences that hold them."""
    open_: dict[int, dict[tuple, int]] = defaultdict(dict)  # by room left: content -> how many
    rooms: list[int] = []

    def put(room: int, content: tuple, times: int) -> None:
        if not open_[room]:
            rooms.insert(bisect_left(rooms, room), room)
        open_[room][content] = open_[room].get(content, 0) + times

    for w in sorted((w for w, n in count.items() if n), reverse=True):
        n = count[w]
        while n:
            i = bisect_left(rooms, w)
            if i == len(rooms):
                room, content, there = capacity, (), n
            else:
                room = rooms[i]
                content, there = open_[room].popitem()
                if not open_[room]:
                    rooms.pop(i)
            k = room // w
            whole = min(there, n // k)
            if whole:
                put(room - k * w, (*content, (w, k)), whole)
            n -= whole * k
            spare = there - whole
            if content and spare and n and n < k:
                put(room - n * w, (*content, (w, n)), 1)
                spare, n = spare - 1, 0
            elif not content and n:
                put(room - n * w, ((w, n),), 1)
                n = 0
            if content and spare:
                put(room, content, spare)
        count[w] = 0
    return [(list(content), times) for there in open_.values() for content, times in there.items()]


def solve(count: dict[int, int], capacity: int) -> list[Pattern]:
    left = dict(count)
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


def places(patterns: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """Runs of ranks among the pieces of a length: first rank, copies a sequence, first sequence, offset there; sorted by length, rank."""
    next_rank: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for parts, times in patterns:
        offset = 0
        for w, k in parts:
            rows.append((w, next_rank[w], k, base, offset))
            next_rank[w] += k * times
            offset += k * w
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"first": np.searchsorted(table[:, 0], np.arange(capacity + 2)), "rank": table[:, 1], "copies": table[:, 2], "base": table[:, 3], "offset": table[:, 4]}


def encoded(batch: pa.RecordBatch, model: WordTokenizer) -> Iterator[tuple[int | None, bytes]]:
    """Ids of the batch's texts, some texts at a time."""
    keys, texts = batch.column(0).to_pylist(), batch.column(1)
    group = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(), dtype=np.int64) // GROUP_BYTES
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)).tolist() if len(keys) else []
    for at, end in zip(edges, edges[1:], strict=False):
        yield from zip(keys[at:end], model.ids(texts.slice(at, end - at)), strict=True)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """A row per piece; local is its rank among the pieces of its length that its task made."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local", pa.int64())] + [("ids", pa.binary())] * with_ids)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, ranks, out = WordTokenizer(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1), Rows(schema)
        for batch in batches:
            for i, ids in encoded(batch, model):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    out.add(i, piece, at // 4, length, zlib.crc32(own), part, ranks[length], *[own] * with_ids)
                    ranks[length] += 1
                if out.full:
                    yield out.take()
        yield out.take()

    return id_and_text(docs, id_col, text_col).transform(map_arrow, run, PIECE + ", ids binary" * with_ids)


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece; with_ids adds the packed ids."""
    spark = docs.sparkSession
    made = Scratch(spark, "packing").keep(pieces(docs, id_col, text_col, tokenizer, end_id, capacity, with_ids), "pieces")
    count = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in count.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    find = spark.sparkContext.broadcast(places(solve(totals, capacity), capacity))
    before = count.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = made.join(before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before")), ["length", "part"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = find.value
        for b in batches:
            rank, length = b.column("rank").to_numpy(), b.column("length").to_numpy()
            lo, hi = at["first"][length], at["first"][length + 1]
            while (lo + 1 < hi).any():  # the last run of the length that begins at or before the rank
                mid = (lo + hi) // 2
                right = (lo + 1 < hi) & (at["rank"][np.minimum(mid, len(at["rank"]) - 1)] <= rank)
                lo, hi = np.where(right, mid, lo), np.where(~right & (lo + 1 < hi), mid, hi)
            turn, copies = rank - at["rank"][lo], at["copies"][lo]
            more = [pa.array(at["base"][lo] + turn // copies, pa.int64()), pa.array(at["offset"][lo] + turn % copies * length, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *more], names=[*names, "sequence_id", "offset"])

    placed = ranked.select(*names, (F.col("before") + F.col("local")).alias("rank")).transform(map_arrow, place, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long")
    return placed
