"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraph cells: at line breaks, after punctuation, and after words chosen by their
own hash, so that a long paragraph changes only near an edit.  Each distinct digest is added to three
cells of a sketch (count, sum of digests, sum of check hashes).  Sketches of two versions subtract; what
is left is peeled, cell by cell that holds one digest, down to the differing digests.  Where peeling
gets stuck, it is retried with sketches four times as large.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import SPACED, Words, chunks, flat, keep, mix, partitions, sequence_hash, spread

#: Cells of a fingerprint, in three equal parts; larger sketches are used only to compare.
CELLS = 24
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?;:,|"]] = True
_ROUGH = 15  # a word ends a paragraph cell if these bits of its hash are 0


class Digests(NamedTuple):
    """Distinct 64-bit digests of several texts; ``count``: of each text's."""

    text: np.ndarray
    key: np.ndarray
    count: np.ndarray


def digests(data: np.ndarray, off: np.ndarray) -> Digests:
    """Digests of all paragraph cells of each text; a repeat within a text counts by its number."""
    w, n = Words(data, off, SPACED), len(off) - 1
    if not len(w.start):
        none = np.zeros(0, np.int64)
        return Digests(none, none.astype(np.uint64), np.zeros(n, np.int64))
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    last = np.ones(len(w.start), bool)
    last[:-1] = lines[w.start[1:]] > lines[w.end[:-1]]
    last |= _STOP[data[w.end - 1]] | ((w.hash & np.uint64(_ROUGH)) == 0)
    last[w.first[1:][w.count > 0] - 1] = True
    to = np.flatnonzero(last) + 1
    key = sequence_hash(w.hash, np.concatenate(([0], to)), 3)
    text = np.searchsorted(w.first, to - 1, "right") - 1
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    at = np.arange(len(key))
    repeat = at - at[new][np.cumsum(new) - 1]
    return Digests(text, mix(key + repeat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 4), np.bincount(text, minlength=n))


class Sketch:
    """Sketches of ``n`` texts with ``cells`` cells each, as flat arrays."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int64)
        self.key, self.check = np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)

    def places(self, text: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
        third = self.cells // 3
        return [text * self.cells + i * third + (mix(key, 11 + i + self.cells) % np.uint64(third)).astype(np.int64) for i in range(3)]

    def add(self, text: np.ndarray, key: np.ndarray, sign: np.ndarray | int = 1) -> np.ndarray:
        """Add (or with sign -1 take away) digests; the cells touched."""
        check, sign = mix(key, 9), np.broadcast_to(np.int64(sign) if np.isscalar(sign) else sign, key.shape)
        k, c = (np.where(sign > 0, x, np.uint64(0) - x) for x in (key, check))
        places = self.places(text, key)
        for at in places:
            np.add.at(self.count, at, sign)
            np.add.at(self.key, at, k)
            np.add.at(self.check, at, c)
        return np.concatenate(places)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, digest, sign) of what is recovered, and which texts were recovered whole."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        at = np.flatnonzero(np.abs(self.count) == 1)
        while len(at):
            at = np.unique(at)
            sign = self.count[at]
            at, sign = at[np.abs(sign) == 1], sign[np.abs(sign) == 1]
            key = np.where(sign > 0, self.key[at], np.uint64(0) - self.key[at])
            pure = np.where(sign > 0, self.check[at], np.uint64(0) - self.check[at]) == mix(key, 9)
            text, key, sign = at[pure] // self.cells, key[pure], sign[pure]
            if not len(key):
                break
            order = np.lexsort((key, text))
            text, key, sign = text[order], key[order], sign[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            text, key, sign = text[new], key[new], sign[new]
            out.append((text, key, sign))
            at = self.add(text, key, -sign)
        whole = ~((self.count != 0) | (self.key != 0)).reshape(self.n, self.cells).any(axis=1)
        return *(np.concatenate(x) for x in zip(*out, strict=True)), whole

    def text(self, counts: np.ndarray) -> list[str]:
        """Fingerprints: number of digests and all cells, in base64."""
        a = np.empty((self.n, self.cells), np.dtype([("c", "<u2"), ("k", "<u8"), ("h", "<u4")]))
        a["c"], a["k"], a["h"] = (x.reshape(self.n, self.cells) for x in (self.count & 0xFFFF, self.key, self.check & np.uint64(0xFFFFFFFF)))
        heads = counts.astype("<u4")
        return [base64.b64encode(h.tobytes() + row.tobytes()).decode() for h, row in zip(heads, a, strict=True)]


def difference(a: Digests, b: Digests) -> tuple[Digests, Digests, np.ndarray]:
    """For each pair of texts: digests only in the first, only in the second, and cells that it took."""
    n, cells = len(a.count), CELLS
    took, out = np.zeros(n, np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    open_ = np.arange(n)
    while len(open_):
        local = np.full(n, -1, np.int64)
        local[open_] = np.arange(len(open_))
        s = Sketch(len(open_), cells)
        for d, sign in ((a, 1), (b, -1)):
            sel = local[d.text] >= 0 if len(d.text) else np.zeros(0, bool)
            s.add(local[d.text[sel]], d.key[sel], sign)
        text, key, sign, whole = s.peel()
        done = whole[text]
        out.append((open_[text[done]], key[done], sign[done]))
        took[open_[whole]] = cells
        open_, cells = open_[~whole], cells * 4
    text, key, sign = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((key, text))
    text, key, sign = text[order], key[order], sign[order]
    one, other = (Digests(text[sign == v], key[sign == v], np.bincount(text[sign == v], minlength=n)) for v in (1, -1))
    return one, other, took


def likeness(a: Digests, b: Digests) -> np.ndarray:
    """Share of common digests among all of both texts, from the peeled difference; 1 for two empty texts."""
    x, y = (d.count for d in difference(a, b)[:2])
    common = a.count - x
    union = common + x + y
    return np.where(union > 0, common / np.maximum(union, 1), 1.0)


def changes(pairs: DataFrame) -> DataFrame:
    """doc_id, dropped, added array<long>, cells long: the paragraph digests that only the ``old`` or only the ``new``
    text of each row has, ascending, and the size of the sketch that gave them.

    A null text counts as empty; a null doc_id stays null; repeated rows are compared each; an empty table gives no
    rows.  Only ``doc_id``, ``old`` and ``new`` are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _, _ in chunks(batches, "old"):
            for part, data, off in chunks(iter([some]), "new"):
                one, other, took = difference(digests(*flat(part.column(1))), digests(data, off))
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(one), _lists(other), pa.array(took)], ["doc_id", "dropped", "added", "cells"])

    return keep(pairs, "doc_id", "old", "new").mapInArrow(run, "doc_id long, dropped array<long>, added array<long>, cells long")


def _lists(d: Digests) -> pa.Array:
    """The digests of each text as signed numbers, ascending."""
    key = d.key.view(np.int64)
    order = np.lexsort((key, d.text))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(d.count))), pa.int32()), pa.array(key[order]))


def _pick(d: Digests, which: np.ndarray) -> Digests:
    """Digests of some of the texts (in any order, with repeats)."""
    first = np.concatenate(([0], np.cumsum(d.count)))
    n = d.count[which]
    at = spread(first[which], n)
    return Digests(np.repeat(np.arange(len(which)), n), d.key[at], n)


def _sketched(d: Digests) -> list[str]:
    s = Sketch(len(d.count), CELLS)
    s.add(d.text, d.key)
    return s.text(d.count)


def versions(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and its edited version, in which the last half of the code points is replaced
    by as many first ones of the next document in descending doc_id; after the last comes the first.

    Null and empty texts have the sketch of nothing; a null doc_id comes last; rows of one doc_id are
    ordered by text, so that repeats are each other's next; an only row is its own next; an empty table
    gives no rows.  Other columns are not read.  Rows travel once, to buckets of neighbouring ids; the
    first row of a bucket also goes to the bucket before it.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"))
    buckets = 4 * parts
    cuts = np.unique(np.array(docs.where("doc_id is not null").approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets), np.float64).astype(np.int64))
    bucket = F.pandas_udf(lambda key: pd.Series(len(cuts) - np.searchsorted(cuts, key.to_numpy(), "right")), "int")
    # At most one row for each bucket: the id that opens it.
    opens = sorted((r[0], r[1]) for r in docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key")).groupBy(bucket("key").alias("b")).agg(F.max("key")).collect())
    before = [(key, opens[i - 1][0]) for i, (_, key) in enumerate(opens)]
    halo = spark.createDataFrame(before, "key long, before int")
    places = F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("halo")), F.struct(F.col("before").alias("b"), F.lit(1).alias("halo")))
    dealt = (
        keyed.withColumn("b", bucket("key")).join(F.broadcast(halo), "key", "left")
        .select("doc_id", "text", "key", F.explode(F.filter(places, lambda p: p["b"].isNotNull())).alias("p"))
        .select("doc_id", "text", "key", "p.b", "p.halo").repartition(parts, "b").sortWithinPartitions("b", "halo", F.desc("key"), "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size = now = 0
        for batch in batches:
            cols = [batch.column(i) for i in (0, 1, 3, 4)]
            for doc_id, text, b, is_halo in zip(*(c.to_pylist() for c in cols), strict=True):
                if now is None and is_halo and b == last:
                    continue  # of several rows with the opening id only the first is next
                now, last = (None if is_halo else b), b
                texts.append(text)
                size += len(text)
                if is_halo:
                    yield _compare(ids, texts)
                    ids, texts, size = [], [], 0
                    continue
                ids.append(doc_id)
                if size > 1 << 20 and len(ids) > 1:
                    yield _compare(ids[:-1], texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(text)
        assert not ids

    names = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, names)


def _compare(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of consecutive documents; ``texts`` has the one after the last besides."""
    own, edited = texts[:-1], []
    for text, follows in zip(own, texts[1:], strict=True):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + follows[:half])
    a = digests(*flat(pa.array(texts, pa.large_string())))
    e = digests(*flat(pa.array(edited, pa.large_string())))
    one, nxt = _pick(a, np.arange(len(own))), _pick(a, np.arange(1, len(texts)))
    columns = [
        pa.array(ids, pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
        pa.array(_sketched(one), pa.string()), pa.array(_sketched(e), pa.string()), pa.array(likeness(one, e)), pa.array(likeness(one, nxt)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
