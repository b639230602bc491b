"""Suffix-array deduplication of bytes with a run-length index.

Texts are treated as UTF-8 bytes.  Windows of ``k`` bytes meet by super-k-mers; strings of a bucket whose
bytes around the minimiser occur once can hold no repeat, the others enter a run-compressed Burrows-Wheeler transform.
Of their suffix order only the suffixes at both ends of each run are kept.  These samples give, for every other
suffix too, the suffix before it in the order and how much the two share: both shift by one from a byte to the one
before it, until a run begins.  So these matching statistics are streamed over all texts, and suffixes that follow
each other with ``k`` shared bytes or more form the classes of equal windows, of which the earliest stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from ._superkmers import Blob, combine, numbered, ranked, spans_of
from ._text import block_hash, mix, prefix_sums, range_hash, runs, spread, unpacked
from .substrings import covered_spans, flags_of, with_spans

#: Bytes of a minimiser.
M_BYTES = 16
#: Symbols that the first sorting key holds.
_PACK = 7
#: Suffixes that are streamed at once.
_STREAM = 1 << 18


def byte_items(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, None, None]:
    # A mixed value for each byte, so that sums of powers spread over all 64 bits.
    return _MIXED[data], off, None, None


_MIXED = mix(np.arange(256, dtype=np.uint64), 40)


class RunLengthIndex:
    """Index of several strings (bytes end to end, offsets).

    Positions count the bytes and a mark after each string; marks are unlike each other, sort before all bytes and by
    string.  ``head``: symbol of each run of the transform (0 for a mark, else the byte + 1); ``first``, ``last``:
    suffixes of its first and last rows.  ``place``: sorted positions at which the suffix before, ``before``, and
    the bytes shared with it, ``shared``, are kept: one for each run, and the marks.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n, strings = len(data), len(off) - 1
        self.size, self.data, self.off = n + strings, data, off
        self.mark = off[1:] + np.arange(strings)
        self.begin_at = np.concatenate(([0], self.mark[:-1] + 1)) if strings else np.zeros(0, np.int64)
        text = np.zeros(self.size, np.int16)
        text[np.arange(n) + np.repeat(np.arange(strings), np.diff(off))] = data.astype(np.int16) + 1
        order = suffix_order(text, self.mark, np.repeat(self.mark, np.diff(off) + 1))
        previous = np.where(order > 0, text[order - 1], 0)  # a mark precedes each first byte
        new = np.ones(self.size, bool)
        new[1:] = previous[1:] != previous[:-1]
        begin = np.flatnonzero(new)
        self.head = previous[begin]
        self.first, self.last = order[begin], order[np.append(begin[1:], self.size) - 1]
        del order, previous, text
        self._sample()

    def _sample(self) -> None:
        """One byte before a run's first suffix stands what follows, in the order, that before the last suffix of the
        run before with the same symbol, or else of the last run of the symbol before."""
        by_symbol = np.argsort(self.head, kind="stable")
        by_symbol = by_symbol[self.head[by_symbol] > 0]
        place = np.concatenate((self.first[by_symbol] - 1, self.mark))
        before = np.concatenate((self.mark[-1:], self.last[by_symbol[:-1]] - 1, [-1], self.mark[:-1]))[-len(place) :]
        order = np.argsort(place)
        self.place, self.before = place[order], before[order]
        self.shared = np.zeros(len(place), np.int64)
        known = np.flatnonzero(self.before >= 0)
        self.shared[known] = self.common(self.place[known], self.before[known])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at two positions share, compared eight at a time."""
        s, t = np.searchsorted(self.mark, a), np.searchsorted(self.mark, b)
        most = np.minimum(self.mark[s] - a, self.mark[t] - b)
        a, b = a - s, b - t  # without the marks
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        out, live, done = most.copy(), np.flatnonzero(most > 0), 0
        while len(live):
            differ = eight[a[live] + done] ^ eight[b[live] + done]
            low = differ & (np.uint64(0) - differ)  # the lowest bit that differs tells the first byte
            stop = differ != 0
            found = live[stop]
            out[found] = np.minimum(most[found], done + np.log2(low[stop].astype(np.float64)).astype(np.int64) // 8)
            live = live[~stop]
            done += 8
            live = live[most[live] > done]
        return out

    def statistics(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the suffixes at some positions, the one before each in the order (-1 if nothing like it is) and the bytes
        that both share."""
        i = np.searchsorted(self.place, at)
        gap, before = self.place[i] - at, self.before[i]
        return np.where(before >= 0, before - gap, -1), np.where(before >= 0, self.shared[i] + gap, 0)

    def stream(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions, suffixes before, bytes shared) of all suffixes, from the last to the first."""
        for end in range(self.size, 0, -_STREAM):
            at = np.arange(max(0, end - _STREAM), end)
            yield at, *self.statistics(at)

    def earliest(self, k: int) -> np.ndarray:
        """For each position, the least one whose next ``k`` bytes are equal; itself where nothing else is, or where
        its string ends sooner."""
        root = np.arange(self.size)
        for at, before, shared in self.stream():
            long = shared >= k
            root[at[long]] = before[long]
        while True:  # to the first suffix of each class, by doubling
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        least = np.arange(self.size)
        np.minimum.at(least, root, np.arange(self.size))
        return least[root]


def suffix_order(text: np.ndarray, mark: np.ndarray, end_of: np.ndarray) -> np.ndarray:
    """All suffixes sorted, by prefix doubling of those that are not yet told apart; ``end_of``: mark of each position."""
    n = len(text)
    at = np.arange(n)
    key = np.zeros(n, np.uint64)
    for i in range(_PACK):  # symbols up to the mark
        s = np.where(at + i <= end_of, text[np.minimum(at + i, n - 1)], 0)
        key = (key << np.uint64(9)) | s.astype(np.uint64)
    key[mark] = np.arange(len(mark))  # less than any key of a byte
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    done = _PACK
    while True:
        group = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank[order] = group
        many = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(many):
            return order
        who = order[many]
        key = (group[many].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(who + done, end_of[who])].astype(np.uint64)
        again = np.argsort(key)
        order[many], key = who[again], key[again]
        new[many[1:]] = key[1:] != key[:-1]
        new[many[0]] = True
        done *= 2


def repeated_bytes(blob: Blob, hot: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, end) in bytes of what is covered by windows that start earlier too: in a text of a smaller
    key or at a smaller place of the same text.

    Of equal strings all but the earliest are covered whole; the earliest of each kind are indexed, in the
    order of their places, unless the bytes around their minimiser occur once in the bucket.
    """
    sums = prefix_sums(_MIXED[blob.data])
    a, b = blob.off[:-1], blob.off[1:]
    pick, kind = combine(blob, block_hash(blob.data, a, b), block_hash(blob.data, a, b, 9))
    order = np.lexsort((blob.start, blob.key, kind))
    new = np.ones(len(order), bool)
    new[1:] = kind[order[1:]] != kind[order[:-1]]
    earliest = order[new]  # one occurrence of each kind
    own = np.zeros(len(order), bool)
    own[earliest] = True
    own |= (blob.key == blob.key[earliest][kind]) & (blob.start == blob.start[earliest][kind])
    length = (b - a)[pick]
    rest = ~own
    key, start, end = [blob.key[rest]], [blob.start[rest]], [blob.start[rest] + length[kind[rest]]]

    # A string's minimiser is the least of its pieces of m bytes: all its windows share it.
    n = length - m + 1
    at = spread(a[pick], n)
    value = ranked(range_hash(sums, at, at + m), hot)
    least = np.minimum.reduceat(value, np.cumsum(n) - n)
    hit = value == np.repeat(least, n)
    own, at = np.repeat(np.arange(len(pick)), n)[hit], at[hit]
    # A window that holds a minimiser also holds the half of the others' bytes before it, or after it.
    half = -(-(k - m) // 2)
    left, right = at - a[pick[own]] >= half, b[pick[own]] - at >= m + half
    around = np.concatenate((range_hash(sums, at[left] - half, at[left] + m), mix(range_hash(sums, at[right], at[right] + m + half), 6)))
    _, which, count = np.unique(around, return_inverse=True, return_counts=True)
    shared = np.zeros(len(pick), bool)
    shared[np.concatenate((own[left], own[right]))[count[which] > 1]] = True
    if shared.any():
        chosen = np.flatnonzero(shared)
        chosen = chosen[np.lexsort((blob.start[earliest[chosen]], blob.key[earliest[chosen]]))]
        size = length[chosen]
        off = np.concatenate(([0], np.cumsum(size)))
        index = RunLengthIndex(blob.data[spread(a[pick[chosen]], size)], off)
        flags = index.earliest(k) < np.arange(index.size)
        text, s, e = spans_of(flags, np.append(index.begin_at, index.size))
        occ = earliest[chosen[text]]
        key.append(blob.key[occ])
        start.append(blob.start[occ] + s)
        end.append(blob.start[occ] + e - 1 + k)
    return np.concatenate(key), np.concatenate(start), np.concatenate(end)


def drop_repeated_bytes(docs: DataFrame, k: int = 100, m: int = M_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the
    remaining bytes).

    A byte goes if a string of ``k`` bytes covers it that starts earlier too: in a document of a smaller
    doc_id, or in the same one at a smaller place.  Matches end where documents do.  A null text is
    empty; a null doc_id is the largest; rows of one doc_id with different texts count as different
    documents, ordered by digest, and equal rows as one; an empty table gives no rows.
    """
    docs, _ = numbered(docs)
    spans = covered_spans(docs, byte_items, lambda blob, hot: repeated_bytes(blob, hot, k, m), k, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in unpacked(batches):
            gone = flags_of(part, off)
            kept = [data[x:y][~gone[x:y]].tobytes() for x, y in zip(off[:-1], off[1:], strict=True)]
            pieces = [len(runs(gone[x:y])[0]) if gone[x:y].any() else 0 for x, y in zip(off[:-1], off[1:], strict=True)]
            total = np.concatenate(([0], np.cumsum(gone)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(off)), pa.array(np.diff(total[off])), pa.array(pieces, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return with_spans(docs, spans).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
