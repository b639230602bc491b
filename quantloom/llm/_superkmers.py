"""Super-k-mer partitioning: runs of windows that share a minimiser travel together.

A window is ``k`` consecutive items (words or bytes) of a text; its minimiser is the least hash of the
``m`` items long pieces in it.  Equal windows have equal minimisers, so if all windows of a minimiser go
to one bucket, equal windows meet there.  Consecutive windows of one minimiser travel as the one string
that spans them.  A task combines equal strings, groups them by bucket and sends compressed blobs.

Minimisers that are frequent in the corpus are ranked behind all others (the list is the same for every
task and bounded), so a window falls in a crowded bucket only if everything in it is frequent; then its
strings are equal to others and have been combined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import checkpointed, chunks, mix, partitions, prefix_sums, range_hash, runs, sliding_min, spread, windows

#: Bytes of strings that a task gathers before it sends them, and about as many a bucket gets; a bucket is
#: worked through in parts by minimiser, which bounds the memory.
FLUSH, BUCKET, PARTS = 32 << 20, 16 << 20, 16
#: Frequent minimisers that are listed at most (8 bytes each are broadcast).
HOT = 1 << 16
_TOP = np.uint64(1 << 63)


class Runs(NamedTuple):
    """Runs of windows: first item and number of windows of each, its minimiser and its text."""

    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    text: np.ndarray


def ranked(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Order of minimisers: frequent ones after all others."""
    low = hashes >> np.uint64(1)
    if not len(hot):
        return low
    at = np.minimum(np.searchsorted(hot, low), len(hot) - 1)
    return np.where(hot[at] == low, low | _TOP, low)


def find_runs(sums: np.ndarray, first: np.ndarray, k: int, m: int, hot: np.ndarray) -> Runs:
    """``sums``: prefix sums of the items' hashes; ``first``: where each text's items begin."""
    win, _ = windows(first, k)
    if not len(win):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none.astype(np.uint64), none)
    at = np.arange(len(sums) - m)
    least = sliding_min(ranked(range_hash(sums, at, at + m), hot), k - m + 1)[win]
    new = np.ones(len(win), bool)
    new[1:] = (least[1:] != least[:-1]) | (win[1:] != win[:-1] + 1)
    at = np.flatnonzero(new)
    return Runs(win[at], np.diff(np.append(at, len(win))), least[at], np.searchsorted(first, win[at], "right") - 1)


class Blob(NamedTuple):
    """What a bucket gets: distinct strings, and the (text key, first item) of each occurrence."""

    data: np.ndarray  # all strings, end to end
    off: np.ndarray
    owner: np.ndarray  # string of each occurrence
    key: np.ndarray
    start: np.ndarray
    part: np.ndarray  # part of the bucket of each string

    def only(self, part: int) -> Blob:
        """The strings of one part."""
        sel = self.part == part
        place = np.cumsum(sel) - 1
        size = np.diff(self.off)[sel]
        occ = sel[self.owner]
        return Blob(self.data[spread(self.off[:-1][sel], size)], np.concatenate(([0], np.cumsum(size))), place[self.owner[occ]], self.key[occ], self.start[occ], self.part[sel])


def _pack(strings: list[bytes], part: np.ndarray, owner: np.ndarray, key: np.ndarray, start: np.ndarray) -> bytes:
    head = np.array([len(strings), len(owner)], np.int64)
    sizes = np.array([len(s) for s in strings], np.int32)
    step = np.diff(key, prepend=0)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), sizes.tobytes(), part.astype(np.int8).tobytes(), owner.astype(np.int32).tobytes(), step.tobytes(), start.astype(np.int64).tobytes(), *strings]))


def unpack(blobs: Iterator[bytes]) -> Blob:
    """All strings of some blobs; equal strings of different blobs are not yet combined."""
    data, sizes, part, owner, key, start, n = [], [], [], [], [], [], 0
    for blob in blobs:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
        strings, occ = (int(x) for x in raw[:16].view(np.int64))
        at = 16
        parts = []
        for count, kind in ((strings, np.int32), (strings, np.int8), (occ, np.int32), (occ, np.int64), (occ, np.int64)):
            to = at + count * np.dtype(kind).itemsize
            parts.append(np.frombuffer(raw[at:to].tobytes(), kind))
            at = to
        sizes.append(parts[0].astype(np.int64))
        part.append(parts[1])
        owner.append(parts[2].astype(np.int64) + n)
        key.append(np.cumsum(parts[3]))
        start.append(parts[4])
        data.append(raw[at:])
        n += strings
    return Blob(np.concatenate(data), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), *(np.concatenate(x) for x in (owner, key, start, part)))


def combine(blob: Blob, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings by two hashes each: (index of one string of each kind, kind of each occurrence)."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind[blob.owner]


#: (bytes, offsets) to: items' hashes, first item of each text, byte start and end of each item (or None: items are bytes).
Items = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]


def hot_minimisers(docs: DataFrame, items: Items, k: int, m: int, buckets: int) -> np.ndarray:
    """Minimisers with more than a quarter of a mean bucket, from counts over all texts.

    What can be a minimiser at all is among the least hashes: with 8 in ``k - m + 1`` of them a window has none
    once in three thousand.  Only these pieces are counted.  A task reports those with half the share of its
    own, a bounded number.
    """
    none = np.zeros(0, np.uint64)
    low = np.uint64(int(min(1.0, 8 / (k - m + 1)) * ((1 << 63) - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, total = none, np.zeros(0, np.int64), 0
        for _, data, off in chunks(batches):
            hashes, first, _, _ = items(data, off)
            sums = prefix_sums(hashes)
            at = np.arange(max(0, len(sums) - m))
            value = ranked(range_hash(sums, at, at + m), none)
            # A piece stands for its windows, about half of the k - m + 1 that hold it.
            value = value[value < low]
            total += len(hashes) * 2 // (k - m + 1)
            key, inv = np.unique(np.concatenate((key, value)), return_inverse=True)
            n = np.bincount(inv, np.concatenate((n, np.ones(len(value)))), len(key)).astype(np.int64)
            if len(key) > 1 << 20:  # lossy counting: rare ones are forgotten
                sel = n > max(1, total // (16 * buckets))
                key, n = key[sel], n[sel]
        sel = n > max(1, total // (8 * buckets))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(key[sel], np.uint64(0)).view(np.int64)), pa.array(np.append(n[sel], total)), pa.array(np.append(np.zeros(sel.sum(), bool), True))], ["key", "n", "total"])

    seen = docs.mapInArrow(run, "key long, n long, total boolean").groupBy("total", "key").agg(F.sum("n").alias("n"))
    rows = seen.orderBy(F.desc("total"), F.desc("n"), "key").limit(HOT).collect()  # bounded
    total = sum(r.n for r in rows if r.total)
    hot = np.array([r.key for r in rows if not r.total and r.n > max(64, total // (4 * buckets))], np.int64).view(np.uint64)
    return np.sort(hot)


def bucket_count(docs: DataFrame, expansion: float) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(max(4 * partitions(docs.sparkSession), size * expansion // BUCKET))


def dealt(docs: DataFrame, items: Items, k: int, m: int, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, blob) of all runs of windows of ``docs`` (key, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        strings: list[bytes] = []
        size = 0
        for part, data, off in chunks(batches):
            hashes, first, begin, end = items(data, off)
            sums = prefix_sums(hashes)
            r = find_runs(sums, first, k, m, shared.value)
            if not len(r.start):
                continue
            last = r.start + r.count - 1 + k
            one = range_hash(sums, r.start, last)
            a, b = (r.start, last) if begin is None else (begin[r.start], end[last - 1])
            keys = part.column(0).to_numpy(zero_copy_only=False)[r.text]
            place = mix(r.key, 2) % np.uint64(buckets * PARTS)
            held.append((place.astype(np.int64), one, keys, r.start - first[r.text], np.arange(len(a)) + len(strings)))
            raw = data.tobytes()
            strings += [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            size += int((b - a).sum())
            if size > FLUSH:
                yield flush(held, strings)
                held, strings, size = [], [], 0
        if held:
            yield flush(held, strings)

    def flush(held: list[tuple], strings: list[bytes]) -> pa.RecordBatch:
        place, one, key, start, index = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((start, key, one, place))
        place, one, key, start, index = (x[order] for x in (place, one, key, start, index))
        new = np.ones(len(order), bool)
        new[1:] = (one[1:] != one[:-1]) | (place[1:] != place[:-1])
        for i in np.flatnonzero(~new).tolist():  # equal hashes are not enough
            if strings[index[i]] != strings[index[i - 1]]:
                new[i] = True
        kind = np.cumsum(new) - 1
        index, bucket, part = index[new], place // PARTS, (place % PARTS)[new]
        edge = np.flatnonzero(np.diff(bucket, prepend=-1))
        out = []
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)], strict=True):
            own = kind[a:b]
            lo, hi = own[0], own[-1] + 1
            out.append(_pack([strings[i] for i in index[lo:hi].tolist()], part[lo:hi], own - lo, key[a:b], start[a:b]))
        return pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int32)), pa.array(out, pa.binary())], ["bucket", "blob"])

    return docs.mapInArrow(run, "bucket int, blob binary")


def numbered(docs: DataFrame, *more: str) -> tuple[DataFrame, bool]:
    """(key, doc_id, text, and the columns of ``more``) with a key that orders like doc_id (null last) and
    tells texts of one id apart, and whether the key is the id.

    That is so where ids are unique and not null.  Else distinct (id, text) pairs get increasing numbers in order,
    so equal rows share a key.
    """
    docs = docs.select("doc_id", "text", *more)
    n, ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.max(F.col("doc_id").isNull())).first()
    if (n or 0) <= 1 and not ids:
        return docs.select(F.col("doc_id").alias("key"), "doc_id", "text", *more), True
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    pairs = docs.select("doc_id", digest.alias("digest")).distinct().orderBy(F.col("doc_id").asc_nulls_last(), "digest")
    # Increasing along the sorted partitions; a table, as numbers must not be dealt twice.
    named = checkpointed(pairs.select(F.col("doc_id").alias("own_id"), F.col("digest").alias("own_digest"), F.monotonically_increasing_id().alias("key")))
    found = docs.join(named, F.col("doc_id").eqNullSafe(F.col("own_id")) & (digest == F.col("own_digest")))
    return found.select("key", "doc_id", "text", *more), False


def spans_of(flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the maximal runs of true flags, cut where texts end; starts count within texts."""
    edged = np.zeros(len(flags) + len(first) - 1, bool)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    edged[np.arange(len(flags)) + owner] = flags
    a, b = runs(edged)
    place = first[:-1] + np.arange(len(first) - 1)
    text = np.searchsorted(place, a, "right") - 1
    return text, a - place[text], b - place[text]
