"""Vectorised byte-level helpers shared by the text operators.

Texts arrive as Arrow string columns.  Their buffers are read as flat ``uint8`` arrays, so words,
shingles and windows are found with a handful of array passes and no Python object per word.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once; bounds the working memory of a Python worker.
CHUNK = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PI = np.uint64(pow(int(_P), -1, 1 << 64))
#: Powers are kept for so many places; longer texts compute theirs anew, so that a worker's memory stays small.
KEPT_POWERS = CHUNK
_powers: list[np.ndarray] = []
_C = ctypes.CDLL(None)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); it goes when the
    application ends.  Only on one machine, where none is set, a temporary folder serves; a cluster without is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif re.match(r"local($|\[)", spark.sparkContext.master):
            base = tempfile.mkdtemp(prefix="checkpoints-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at, fs = _file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{path}/data"


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        at, fs = _file_system(spark, path)
        fs.delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; sets a folder only where the session names none."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``limit`` bytes: (slice, bytes, offsets).  A longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to
    trim()


def trim() -> None:
    """Give freed memory back to the system: workers live on after a task, and others need it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def packed(df: DataFrame, column: str = "text") -> DataFrame:
    """The table with a text column compressed, to travel: ``packed`` and its length ``raw`` in its place."""
    at = df.columns.index(column)
    rest = [c for c in df.columns if c != column]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != column) + ", packed binary, raw long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for part, data, off in chunks(batches, column):
            blobs = pa.array([packer.compress(data[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(part.columns) if i != at), blobs, pa.array(np.diff(off))], [*rest, "packed", "raw"])

    return df.mapInArrow(run, schema)


def unpacked(batches: Iterator[pa.RecordBatch], limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices like those of ``chunks`` of a table that ``packed`` made."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.concatenate(([0], np.cumsum(batch.column(batch.schema.get_field_index("raw")).to_numpy())))
        blobs, at = batch.column(batch.schema.get_field_index("packed")), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            data = np.frombuffer(b"".join([unpacker.decompress(x.as_py()) for x in blobs.slice(at, to - at)]), np.uint8)
            yield batch.slice(at, to - at), data, ends[at : to + 1] - ends[at]
            at = to


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse modulo 2^64, at least ``n`` of them."""
    have = _powers
    if not have or len(have[0]) < n:
        size, have = 1 << max(16, int(n - 1).bit_length()), []
        for x in (_P, _PI):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            have.append(np.cumprod(p, dtype=np.uint64))
        if size <= KEPT_POWERS:
            _powers[:] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of values[i:j] times powers modulo 2^64; for hashes of any range in O(1)."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], dtype=np.uint64, out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range [start, end) of what ``prefix_sums`` was given; equal ranges, equal hashes.

    Different long ranges with a recursive pattern collide, so this only ranks, deals out and proposes; what
    decides that two things are equal is one of the hashes below, or the bytes themselves.
    """
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


#: Bytes from which on a range is hashed by itself.
_LONG = 1 << 10


def block_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of each byte range [start, end): eight bytes at a time go through a mixing chain."""
    n = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix(n.astype(np.uint64), 100 + seed)
    live = np.flatnonzero((n > 0) & (n < _LONG))
    done = 0
    while len(live):
        left = n[live] - done
        cut = np.where(left >= 8, 0, 8 * (8 - left)).astype(np.uint64)
        out[live] = mix(out[live] ^ (eight[start[live] + done] << cut))
        live, done = live[left > 8], done + 8
    for i in np.flatnonzero(n >= _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
    return out


def sequence_hash(values: np.ndarray, first: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of each run values[first[i]:first[i + 1]]: a sum of mixes of value and place, so that no pattern
    of places cancels."""
    n = np.diff(first)
    place = np.arange(int(first[-1] - first[0])) - np.repeat(first[:-1] - first[0], n)
    each = mix(mix(values[first[0] : first[-1]], 200 + seed) + place.astype(np.uint64) * _P, 201 + seed)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)))
    return mix(total[first[1:] - first[0]] - total[first[:-1] - first[0]] + n.astype(np.uint64), 202 + seed)


def gram_hash(values: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """64 bits of each ``k`` consecutive values (as many as there are starts), as a tree of mixes by doubling."""
    total = max(0, len(values) - k + 1)
    power, have, out, at = 1, mix(values, 300 + seed), None, 0
    while power <= k:
        if k & power:
            piece = have[at : at + total]
            out = piece if out is None else mix(out * _P + piece, 301 + seed)
            at += power
        if power * 2 <= k:
            have = mix(have[:-power] * _P + have[power:], 302 + seed)
        power *= 2
    return out


def table(*excluded: tuple[int, int]) -> np.ndarray:
    """Which byte values belong to words: all but the given inclusive ranges."""
    t = np.ones(256, bool)
    for a, b in excluded:
        t[a : b + 1] = False
    return t


#: Words as runs of anything but the space and \t \n \v \f \r.
SPACED = table((0x20, 0x20), (0x09, 0x0D))
#: Words as runs of lower-case letters, digits and all beyond ASCII.
ALNUM = table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of a chunk of texts.

    ``start``/``end``: byte range of each word; ``first``: index of the first word of each text,
    with the total as last; ``hash``: 64 bits of each word.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, members: np.ndarray, hashes: bool = True):
        inside = members[data]
        cut = np.unique(off[:-1][off[:-1] < len(data)])
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[cut] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[cut[cut > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        if hashes:
            self.hash = block_hash(data, self.start, self.end)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``k`` items that stay in one text, and the number of each text's."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    return spread(first[:-1], n), n


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ..., n[i] of them, for each i in turn."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(start - (np.cumsum(n) - n), n)
    return base + np.arange(total)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values, by doubling."""
    if len(values) < w:
        return values[:0]
    have, out = 1, values
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in any range [start, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def keep(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns that an operator reads, so that others neither travel nor clash."""
    return docs.select(*columns)
