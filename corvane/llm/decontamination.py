"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and underscores of the lower-cased text. A test item and a document are compared when
they share a seed, a run of `min_match` words, and the item's words inside such seeds reach the threshold; tiles cover no others. Running Karp-Rabin then tiles the pair: beginning with long search lengths,
it finds all matches of unmarked words, marks the longest on both sides, and goes on with the next longest, what a tile has left
of a match waiting at its new length; then it halves the search length, down to `min_match`. So each tile is the longest free
match there is, as in plain greedy tiling. Tiles may stand in any order, so reordered passages count. A document holds an item
when the tiles cover at least `threshold` of the item's words. An item of fewer than `min_match` words is one seed of its own length.

The benchmark is the stated query set: its seeds go to the tasks in blocks of at most `block_words` words, one pass over
the documents for each block, so what is broadcast has a fixed bound however long the benchmark is. Where there are several blocks,
contamination() writes what each finds before the next is sent.

Results for edge cases: null and empty texts, and items without words, hold nothing. Texts of any length are read whole. Equal
items are reported each under its own item_id; an item id that repeats with equal text is reported once. Null ids stay null.
Repeated document rows give repeated result rows. Empty tables give an empty result. Other columns are not read, whatever
their names; decontaminate() passes them on, keeps documents whose text is null or empty, and keeps or drops repeated rows alike.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import Rows, Scratch, id_and_text, map_arrow, rows_of, small_batches, trim, window_hashes

_WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, item_id long, item_words long, covered_words long, n_tiles long, coverage double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("covered_words", pa.int64()), ("n_tiles", pa.int64()), ("coverage", pa.float64())])
_BITS = 24


def words(text: bytes | None) -> list[str]:
    return _WORD.findall(text.decode("utf-8", "replace").lower()) if text else []


def tile(item: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length) of two word-id arrays, in the order in which they are marked; negative ids match nothing.

    Each is the longest match of free words there is, of several the first in the item, then in the text.
    """
    free_item, free_text = item >= 0, text >= 0
    tiles: list[tuple[int, int, int]] = []
    s = max(min_match, min(len(item), 64))
    while True:
        found = _scan(item, text, free_item, free_text, s)
        heapify(found)
        while found:
            n, i, j = heappop(found)
            free = free_item[i : i - n] & free_text[j : j - n]
            if free.all():
                free_item[i : i - n] = False
                free_text[j : j - n] = False
                tiles.append((i, j, -n))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
            for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):  # what a tile has left of the match waits for its turn
                if hi - lo >= s:
                    heappush(found, (lo - hi, i + lo, j + lo))
        if s == min_match:
            return tiles
        s = max(min_match, s // 2)


def _scan(item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """All maximal matches of s unmarked words or more: less their length, place in item, place in text."""
    if len(item) < s or len(text) < s:
        return []
    runs_item, runs_text = _free_runs(free_item, s), _free_runs(free_text, s)
    a, b = window_hashes(item.astype(np.uint64), s), window_hashes(text.astype(np.uint64), s)
    at: dict[int, list[int]] = defaultdict(list)
    for i in np.flatnonzero(runs_item):
        at[int(a[i])].append(int(i))
    if not at:
        return []
    hits = np.flatnonzero(runs_text & np.isin(b, np.fromiter(at, np.uint64, len(at))))
    found, ends = [], {}
    for j in hits.tolist():
        for i in at[int(b[j])]:
            if ends.get(i - j, -1) > j:  # inside a match that was extended over this place
                continue
            n = 0
            while i + n < len(item) and j + n < len(text) and free_item[i + n] and free_text[j + n] and item[i + n] == text[j + n]:
                n += 1
            if n >= s:
                ends[i - j] = j + n
                found.append((-n, i, j))
    return found


def _free_runs(free: np.ndarray, s: int) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(free)])
    return c[s:] - c[:-s] == s


class Block:
    """The word ids, seeds and items of one block of the benchmark."""

    def __init__(self, items: list[tuple[int | None, list[str]]], min_match: int):
        self.ids: dict[str, int] = {}
        self.items = [(k, np.array([self.ids.setdefault(w, len(self.ids)) for w in ws], np.int64)) for k, ws in items]
        self.min_match = min_match
        #: By size of seeds: their hashes, bits that most others lack, where each one's places begin, and the places among all items' words.
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.begins = np.cumsum([0] + [len(ws) for _, ws in self.items])
        by_size: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for n, (_, ws) in enumerate(self.items):
            size = min(min_match, len(ws))
            h = window_hashes(ws.astype(np.uint64), size)
            by_size[size].append((h, self.begins[n] + np.arange(len(h))))
        for size, seeds in by_size.items():
            h, at = (np.concatenate(x) for x in zip(*seeds, strict=True))
            order = np.lexsort((at, h))
            keys, first = np.unique(h[order], return_index=True)
            maybe = np.zeros(1 << _BITS >> 3, np.uint8)
            low = (keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)
            np.bitwise_or.at(maybe, low >> 3, (1 << (low & 7)).astype(np.uint8))
            self.sizes[size] = keys, maybe, np.append(first, len(h)), at[order]

    def _within(self, size: int, hit: np.ndarray, threshold: float) -> np.ndarray:
        """Items of which words enough stand in these seeds. Tiles cover no others, so the rest need not be tiled."""
        _, _, first, places = self.sizes[size]
        n = first[hit + 1] - first[hit]
        at = np.sort(places[np.repeat(first[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        words_ = np.minimum(np.diff(at, append=at[-1] + size), size)  # a seed ends with its item at the latest
        item = np.searchsorted(self.begins, at, "right") - 1
        which, begin = np.unique(item, return_index=True)
        most = np.add.reduceat(words_, begin)
        return which[most >= threshold * (self.begins[which + 1] - self.begins[which])]

    def holds(self, text: bytes | None, threshold: float = 0.0) -> Iterator[tuple]:
        """(item id, words, covered words, tiles) of each item that shares a seed with the text, but for those that cannot reach the threshold."""
        get = self.ids.get
        own = [get(w, -1) for w in words(text)]
        if not own:
            return
        ids = np.array(own, np.int64)
        known = ids >= 0
        pairs: set[int] = set()
        cover = np.zeros(len(ids) + 1, np.int32)
        for size, (keys, maybe, *_) in self.sizes.items():
            if len(ids) < size or not (runs := np.flatnonzero(_free_runs(known, size))).size:
                continue
            h = window_hashes(ids.astype(np.uint64), size)[runs]
            low = (h & np.uint64((1 << _BITS) - 1)).astype(np.int64)
            some = maybe[low >> 3] >> (low & 7) & 1 == 1
            h, runs = h[some], runs[some]
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            if hit.any():
                pairs.update(self._within(size, np.unique(place[hit]), threshold).tolist())
            np.add.at(cover, runs[hit], 1)
            np.add.at(cover, runs[hit] + size, -1)
        if not pairs:
            return
        inside = np.cumsum(cover)[:-1] > 0  # only words inside seeds can be tiled; a gap keeps the parts apart
        edge = inside & ~np.concatenate([[False], inside[:-1]])
        order = np.flatnonzero(inside | np.concatenate([edge[1:], [False]]))
        part = np.where(inside[order], ids[order], -1)
        for n in sorted(pairs):
            item, ws = self.items[n]
            tiles = tile(ws, part, min(self.min_match, len(ws)))
            yield item, len(ws), sum(t[2] for t in tiles), len(tiles)


def blocks(benchmark: DataFrame, item_id: str, item_text: str, min_match: int, block_words: int) -> Iterator[Block]:
    """Reads the benchmark through an iterator, so the driver holds a block at a time, or two."""
    part: list[tuple[int | None, list[str]]] = []
    held = 0
    for row in id_and_text(benchmark, item_id, item_text).distinct().toLocalIterator():
        ws = words(bytes(row["_text"]) if row["_text"] is not None else None)
        if not ws:
            continue
        if part and held + len(ws) > block_words:
            yield Block(part, min_match)
            part, held = [], 0
        part.append((row["_id"], ws))
        held += len(ws)
    if part:
        yield Block(part, min_match)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = 5, threshold: float = 0.5, block_words: int = 1_000_000) -> DataFrame:
    """A row per document and item it holds."""
    spark, found, scratch = docs.sparkSession, [], Scratch(docs.sparkSession, "tiles")
    texts = id_and_text(docs, id_col, text_col)
    every = blocks(benchmark, item_id, item_text, min_match, block_words)
    block = next(every, None)
    while block is not None:
        following = next(every, None)
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            out = Rows(_ARROW)
            for batch in batches:
                for i, text in rows_of(batch):
                    for item, n, covered, tiles in sent.value.holds(text, threshold):
                        if covered >= threshold * n:
                            out.add(i, item, n, covered, tiles, covered / n)
                if out.full:
                    yield out.take()
            yield out.take()

        own = texts.transform(map_arrow, run, SCHEMA)
        if following is not None or found:
            own = scratch.keep(own, "found")
            sent.destroy()
        found.append(own)
        block = following
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = 5, threshold: float = 0.5, block_words: int = 1_000_000) -> DataFrame:
    """The documents that hold no item. Each is judged where it is read, so no text is shuffled."""
    spark, out = docs.sparkSession, docs
    small_batches(spark)
    for block in blocks(benchmark, item_id, item_text, min_match, block_words):
        out = out.filter(~_holds(spark.sparkContext.broadcast(block), threshold)(F.col(text_col).cast("binary")))
    return out


def _holds(sent: Broadcast, threshold: float):
    @F.arrow_udf(T.BooleanType())
    def holds(text: pa.Array) -> pa.Array:
        out = pa.array([any(covered >= threshold * n for _, n, covered, _ in sent.value.holds(t, threshold)) for t in text.to_pylist()], pa.bool_())
        trim()
        return out

    return holds
