"""Sequence packing by bounded-space online best fit.

Each partition keeps a fixed number of open windows.  A document's tokens are cut into full windows
first; what is left goes into the open window with the least room that still holds it.  If none does,
the fullest window is emitted: a large gap is filled with the head of the arriving document, a small
one is left as padding.  The windows still open at the end of a partition travel, with their ids, to
a few merging tasks that fill windows to the brim; each leaves one short window, which is cut at
powers of two so that it needs no padding.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import SPACED, block_hash, chunks, keep, shared_dir, spread

#: Distinct parts of texts, and bytes of these, that a worker remembers; then it begins anew.
MEMO, MEMO_BYTES = 1 << 18, 4 << 20
_WHITE = ~SPACED

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("leftover", pa.binary()),
])


class Encoder:
    """Token ids of whole texts, equal to those that the ``tokenizers`` file gives.

    A byte-level BPE never merges across the place before a space that follows a non-space, so texts
    are cut there into parts.  The ids of parts seen before are looked up by hash, all of a chunk at
    once, and their bytes are compared; the unknown parts are encoded as one joined text and told apart by
    their lengths in bytes.  Texts with white space beyond ASCII are encoded whole, and by ``tokenizers`` itself
    those with one of the file's added tokens, or all where no rank file of the same vocabulary lies beside it.
    """

    def __init__(self, path: str):
        self.path, self.width, self.exact = path, None, None
        added = json.loads(Path(path).read_bytes()).get("added_tokens", ())
        self.added = [t["content"].encode() for t in added]
        try:
            import public_tokenizers
            import tiktoken

            with open(re.sub(r"\.json$", ".tiktoken", path), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.width = np.zeros(max(ranks.values()) + 1, np.int64)
            self.width[list(ranks.values())] = [len(x) for x in ranks]
        except FileNotFoundError:
            pass
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(0, np.uint64)  # sorted hashes of known parts; places and numbers of their ids and bytes
        self.at, self.n, self.seen, self.size = (np.zeros(0, np.int64) for _ in range(4))
        self.ids, self.raw = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def whole(self, text: str) -> np.ndarray:
        """Ids of one text by ``tokenizers``."""
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.path)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")

    def many(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a chunk."""
        raw = data.tobytes()
        if self.width is None:
            return [self.whole(raw[a:b].decode()) for a, b in zip(off[:-1], off[1:], strict=True)]
        space = _WHITE[data]
        begin = np.zeros(len(data), bool)
        begin[1:] = (data[1:] == 32) & ~space[:-1]
        begin[off[:-1][off[:-1] < len(data)]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(data))
        if not len(start):
            return [np.zeros(0, "<u4")] * (len(off) - 1)
        unique, one, which = np.unique(block_hash(data, start, end), return_index=True, return_inverse=True)
        # Equal hashes are not enough: parts that differ from the first one of their hash count as parts of their own.
        same = self._equal(data, start, end - start, data, start[one][which], (end - start)[one][which])
        if not same.all():
            odd = np.flatnonzero(~same)
            which[odd] = len(one) + np.arange(len(odd))
            unique, one = np.concatenate((unique, np.zeros(len(odd), np.uint64))), np.concatenate((one, odd))
        where = np.searchsorted(self.key, unique)
        near = np.minimum(where, max(len(self.key) - 1, 0))
        known = np.zeros(len(unique), bool)
        if len(self.key):
            known = self.key[near] == unique
            hit = np.flatnonzero(known)
            known[hit] = self._equal(data, start[one[hit]], (end - start)[one[hit]], self.raw, self.seen[near[hit]], self.size[near[hit]])
        new = np.flatnonzero(~known)
        fresh, n_new = self._encode(data, raw, space, start[one[new]], end[one[new]])
        at, n = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        at[known], n[known] = self.at[near[known]], self.n[near[known]]
        at[new], n[new] = len(self.ids) + np.cumsum(n_new) - n_new, n_new
        pool = np.concatenate((self.ids, fresh))
        ids = pool[spread(at[which], n[which])].astype("<u4")
        last = np.concatenate(([0], np.cumsum(n[which])))[np.searchsorted(start, off)]
        self._remember(unique, where, new, at, n, pool, data, start[one], end[one])
        out = [ids[a:b] for a, b in zip(last[:-1], last[1:], strict=True)]
        for i in self._wide(data, off):
            out[i] = np.array(self.fast(raw[off[i] : off[i + 1]].decode()), "<u4")
        for i in self._special(raw, off):
            out[i] = self.whole(raw[off[i] : off[i + 1]].decode())
        return out

    @staticmethod
    def _equal(data: np.ndarray, at: np.ndarray, n: np.ndarray, other: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which ranges of two byte arrays are equal."""
        same = n == size
        sel = np.flatnonzero(same & (n > 0))
        if len(sel):
            differ = data[spread(at[sel], n[sel])] != other[spread(place[sel], n[sel])]
            same[sel] = ~np.logical_or.reduceat(differ, np.cumsum(n[sel]) - n[sel])
        return same

    def _remember(self, unique, where, new, at, n, pool, data, start, end) -> None:
        """Keep the new parts, but those that share a known part's hash or are long."""
        if len(self.key) + len(new) > MEMO or len(self.raw) > MEMO_BYTES:
            return self._forget()
        short = (unique[new] != 0) & (end[new] - start[new] < 64)
        if len(self.key):
            short &= self.key[np.minimum(where[new], len(self.key) - 1)] != unique[new]
        new = new[short]
        size = end[new] - start[new]
        seen = len(self.raw) + np.cumsum(size) - size
        columns = ((self.key, unique[new]), (self.at, at[new]), (self.n, n[new]), (self.seen, seen), (self.size, size))
        self.key, self.at, self.n, self.seen, self.size = (np.insert(old, where[new], add) for old, add in columns)
        self.raw, self.ids = np.concatenate((self.raw, data[spread(start[new], size)])), pool

    def _encode(self, data: np.ndarray, raw: bytes, space: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some parts, end to end, and the number of each part's."""
        n = np.zeros(len(start), np.int64)
        joins = (data[start] == 32) & ~space[end - 1]
        ids = np.array(self.fast(b"".join([raw[a:b] for a, b in zip(start[joins].tolist(), end[joins].tolist(), strict=True)]).decode()), np.uint32)
        to = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum((end - start)[joins])) + 1
        n[joins] = np.diff(to, prepend=0)
        alone = {i: np.array(self.fast(raw[start[i] : end[i]].decode()), np.uint32) for i in np.flatnonzero(~joins).tolist()}
        for i, x in alone.items():
            n[i] = len(x)
        out, first = np.zeros(int(n.sum()), np.uint32), np.cumsum(n) - n
        out[spread(first[joins], n[joins])] = ids
        for i, x in alone.items():
            out[first[i] : first[i] + len(x)] = x
        return out, n

    def _special(self, raw: bytes, off: np.ndarray) -> list[int]:
        """Texts that hold an added token of the file."""
        found = set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                i = int(np.searchsorted(off, at, "right")) - 1
                if at + len(token) <= off[i + 1]:
                    found.add(i)
                at = raw.find(token, at + 1)
        return sorted(found)

    @staticmethod
    def _wide(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts that hold white space beyond ASCII."""
        lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
        a = data[lead]
        b, c = (data[np.minimum(lead + i, len(data) - 1)] for i in (1, 2))
        odd = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        odd |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        return np.unique(np.searchsorted(off, lead[odd], "right") - 1)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Open windows of one partition.  ``add`` and ``close`` give finished sequences: lists of pieces."""

    def __init__(self, size: int, windows: int, gap: int):
        self.size, self.gap = size, gap
        self.open: list[list] = [[0, []] for _ in range(windows)]  # tokens, pieces

    def add(self, doc_id: int | None, ids: np.ndarray, total: int, start: int = 0) -> Iterator[list]:
        at = 0
        while len(ids) - at >= self.size:
            yield [(doc_id, start + at, ids[at : at + self.size], total)]
            at += self.size
        while at < len(ids):
            need = len(ids) - at
            fits = [w for w in self.open if w[0] + need <= self.size]
            if fits:
                best = max(fits, key=lambda w: w[0])
                best[0] += need
                best[1].append((doc_id, start + at, ids[at:], total))
                at = len(ids)
                if best[0] == self.size:
                    yield self._take(best)
            else:
                full = max(self.open, key=lambda w: w[0])
                room = self.size - full[0]
                if room > self.gap:
                    full[1].append((doc_id, start + at, ids[at : at + room], total))
                    at += room
                yield self._take(full)

    def _take(self, window: list) -> list:
        pieces, window[0], window[1] = window[1], 0, []
        return pieces

    def close(self) -> Iterator[list]:
        for w in sorted(self.open, key=lambda w: -w[0]):
            if w[0]:
                yield self._take(w)


class _Rows:
    """Collects output rows."""

    def __init__(self):
        self.rows: list[list] = [[] for _ in PIECES]

    def sequence(self, pieces: list, number: int) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.piece(doc_id, start, ids, total, number, at)
            at += len(ids)

    def piece(self, doc_id, start, ids, total, number, at, leftover=None) -> None:
        row = (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, number, at, leftover)
        for column, value in zip(self.rows, row, strict=True):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.rows, PIECES, strict=True)], schema=PIECES)
        self.rows = [[] for _ in PIECES]
        return out


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, windows: int = 64, gap: int = 32, end_id: int = 1, merge: int = 16) -> DataFrame:
    """Pack all documents (``doc_id``, ``text``) into sequences of at most ``size`` tokens.

    One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A null
    text counts as empty and yields the end id alone; a null doc_id stays null; repeated rows are
    packed each; an empty table gives no rows.  Other columns are not read.  ``windows`` bounds the open
    windows of a partition, ``merge`` is how many partitions' leftovers one merging task takes.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, encode, packer, out = TaskContext.get().partitionId(), 0, encoder(tokenizer), Packer(size, windows, gap), _Rows()
        for batch in batches:
            for rows, data, off in chunks(iter((batch,))):
                found = encode.many(data, off)
                for doc_id, ids in zip(rows.column(0).to_pylist(), found, strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for pieces in packer.add(doc_id, ids, len(ids)):
                        out.sequence(pieces, part << 32 | number)
                        number += 1
                if len(out.rows[0]) >= 20_000:
                    yield out.batch()
        for w, pieces in enumerate(packer.close()):
            for at, (doc_id, start, ids, total) in enumerate(pieces):
                out.piece(doc_id, start, ids, total, part << 16 | w, at, ids.tobytes())
        yield out.batch()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, packer, out = TaskContext.get().partitionId(), 0, Packer(size, 1, 0), _Rows()
        mark = 1 << 62 | part << 32
        for batch in batches:
            for row in batch.to_pylist():
                for pieces in packer.add(row["doc_id"], np.frombuffer(row["leftover"], "<u4"), row["doc_tokens"], row["start"]):
                    out.sequence(pieces, mark | number)
                    number += 1
                if len(out.rows[0]) >= 20_000:
                    yield out.batch()
        for pieces in packer.close():
            for cut in _powers(pieces):
                out.sequence(cut, mark | number)
                number += 1
        yield out.batch()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, leftover binary"
    # Both later branches need the first pass once only, so it is written to the shared folder.
    spark = docs.sparkSession
    path = shared_dir(spark, "packed")
    keep(docs, "doc_id", "text").mapInArrow(first, schema).write.parquet(path)
    done = spark.read.schema(schema).parquet(path)
    rest = done.where(F.col("leftover").isNotNull())
    parts = rest.select(F.shiftright("sequence_id", 16).alias("p")).agg(F.max("p")).first()[0]
    groups = 1 + (parts or 0) // merge
    merged = (
        rest.withColumn("g", (F.shiftright("sequence_id", 16) / F.lit(merge)).cast("int"))
        .repartition(groups, "g").sortWithinPartitions("g", "sequence_id", "offset").drop("g").mapInArrow(second, schema)
    )
    return done.where(F.col("leftover").isNull()).drop("leftover").unionByName(merged.drop("leftover"))


def _powers(pieces: list) -> Iterator[list]:
    """Cut a short window at powers of two: no sequence of such a length needs padding."""
    total = sum(len(p[2]) for p in pieces)
    queue = list(pieces)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        cut = []
        while room:
            doc_id, start, ids, n = queue.pop(0)
            cut.append((doc_id, start, ids[:room], n))
            if len(ids) > room:
                queue.insert(0, (doc_id, start + room, ids[room:], n))
            room -= len(cut[-1][2])
        yield cut
