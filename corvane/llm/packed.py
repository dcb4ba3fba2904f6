"""Arrays of whole numbers as bytes for messages between tasks, and the buckets that hashes go to."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame

#: UTF-8 bytes of text for each bucket, and partitions of a shuffle. A bucket is one task's unit of memory, whatever the corpus holds.
BUCKET_BYTES = 6_000_000
MOST_PARTITIONS = 65_536
#: Bits of partition numbers, and of a segment's number within its partition.
PARTITION_BITS, SEGMENT_BITS = 20, 20


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, so that the zero ones compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def unplanes(b: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, len(b) // width).T).view(kind).ravel()


_squeeze, _expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length in few bytes: whole numbers as planes, other numbers as they are, compressed."""
    return _squeeze.compress(b"".join(a.tobytes() if a.dtype.kind == "f" else planes(a) for a in arrays))


def unpack(b: bytes, *kinds: str) -> list[np.ndarray]:
    body, types, out, at = _expand.decompress(b), [np.dtype(k) for k in kinds], [], 0
    n = len(body) // sum(t.itemsize for t in types)
    for t in types:
        part = body[at : at + n * t.itemsize]
        out.append(np.frombuffer(part, t) if t.kind == "f" else unplanes(part, t.str))
        at += len(part)
    return out


class Buckets:
    """Ranges of 64-bit hashes, so sorted hashes are sorted by bucket. A hash keeps 48 bits and those that tell the buckets apart, 64 at most."""

    def __init__(self, volume: int, bucket_bytes: int = BUCKET_BYTES):
        self.n = max(64, min(volume // bucket_bytes, (1 << 32) - 1))
        self.shift = max(0, 16 - (self.n - 1).bit_length())
        self.partitions = min(self.n, MOST_PARTITIONS)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)

    def short(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(self.shift)

    def base(self, bucket: int) -> np.uint64:
        """The least short hash of a bucket."""
        return np.uint64((-(-(bucket << 32) // self.n) << 32) >> self.shift)

    def edges(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that sorted hashes fall into, and where each begins and the last ends."""
        which, first = np.unique(self.of(hashes), return_index=True)
        return which.astype(np.int64), np.append(first, len(hashes))

    def any(self, number: int) -> int:
        """A bucket for what may go to any of them: numbers that are alike are spread."""
        return (number * 0x9E3779B97F4A7C15 >> 13 & 0xFFFFFFFF) * self.n >> 32

    def deal(self, sent: DataFrame, *order: str) -> DataFrame:
        """Each bucket's rows in one partition, as many buckets in each, in the order of bucket and the given columns."""
        return sent.repartitionById(self.partitions, sent["bucket"] % self.partitions).sortWithinPartitions("bucket", *order)


def first_segment(partition: int) -> int:
    """The number of a partition's first segment; each partition has its own range of numbers."""
    if partition >> PARTITION_BITS:
        raise ValueError(f"more than {1 << PARTITION_BITS} partitions")
    return partition << SEGMENT_BITS


def next_segment(seg: int) -> int:
    if (seg + 1) % (1 << SEGMENT_BITS) == 0:
        raise ValueError(f"more than {1 << SEGMENT_BITS} segments in a partition")
    return seg + 1
