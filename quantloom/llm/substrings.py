"""Substring deduplication over words: windows are counted exactly where their super-k-mers meet."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._superkmers import Blob, Items, bucket_count, combine, dealt, hot_minimisers, numbered, spans_of, unpack
from ._text import SPACED, Words, covered, gram_hash, packed, partitions, sequence_hash, unpacked

#: Words of a minimiser; few, so that runs of windows are long and less is sent twice.
M_WORDS = 5


def word_items(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    w = Words(data, off, SPACED)
    return w.hash, w.first, w.start, w.end


def repeated_windows(blob: Blob, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, end) in words of what is covered by windows that also start in a text of a smaller key.

    Two occurrences of one string share all windows, so all but those of the smallest key are covered
    whole.  For that key, equal windows of different strings are brought together by sorting.
    """
    hashes, first, _, _ = word_items(blob.data, blob.off)
    a, b = first[:-1], first[1:]
    pick, kind = combine(blob, sequence_hash(hashes, first), sequence_hash(hashes, first, 9))
    least = np.full(len(pick), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, blob.key)
    whole = blob.key > least[kind]
    length = (b - a)[pick]
    key, start, end = [blob.key[whole]], [blob.start[whole]], [blob.start[whole] + length[kind[whole]]]

    n = np.maximum(length - k + 1, 0)
    at = np.repeat(a[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    owner = np.repeat(np.arange(len(pick)), n)
    h1, h2 = gram_hash(hashes, k)[at], gram_hash(hashes, k, 9)[at]
    order = np.lexsort((h2, h1))
    x, y = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    if len(order):
        smallest = np.minimum.reduceat(least[owner[order]], np.flatnonzero(new))
        flags = np.empty(len(order), bool)
        flags[order] = smallest[np.cumsum(new) - 1] < least[owner[order]]
        text, s, e = spans_of(flags, np.concatenate(([0], np.cumsum(n))))
        # The occurrences with the smallest key, possibly several in one text.
        own = np.flatnonzero(~whole)
        own = own[np.argsort(kind[own], kind="stable")]
        low, high = np.searchsorted(kind[own], text), np.searchsorted(kind[own], text, "right")
        many = high - low
        rep = np.repeat(np.arange(len(text)), many)
        occ = own[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        key.append(blob.key[occ])
        start.append(blob.start[occ] + s[rep])
        end.append(blob.start[occ] + e[rep] - 1 + k)
    return np.concatenate(key), np.concatenate(start), np.concatenate(end)


def covered_spans(docs: DataFrame, items: Items, repeated: Callable[[Blob, np.ndarray], tuple], k: int, m: int) -> DataFrame:
    """(key, spans array<struct<start, end>>) of the texts of which something is covered."""
    buckets = bucket_count(docs, 3.5)
    hot = hot_minimisers(docs.select("key", "text"), items, k, m, buckets)
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def count(table: pa.Table) -> pa.Table:
        whole = unpack(x.as_py() for x in table.column("blob"))
        found = [repeated(whole.only(p), shared.value) for p in np.unique(whole.part)]
        key, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((start, key))
        key, start, end = key[order], start[order], end[order]
        if len(key):  # touching spans of one text become one
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (start[1:] > end[:-1])
            at = np.flatnonzero(new)
            key, start, end = key[at], start[at], np.maximum.reduceat(end, at)
        return pa.table({"key": pa.array(key), "start": pa.array(start), "end": pa.array(end)})

    blobs = dealt(docs.select("key", "text"), items, k, m, hot, buckets)
    found = blobs.repartition(partitions(docs.sparkSession), "bucket").groupBy("bucket").applyInArrow(count, "key long, start long, end long")
    return found.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, compressed text, spans' starts, spans' ends); texts travel compressed."""
    texts = packed(docs.select("key", "doc_id", "text"))
    return texts.join(spans, "key", "left").select("doc_id", "packed", "raw", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))


def flags_of(part: pa.RecordBatch, first: np.ndarray) -> np.ndarray:
    """Which items of the texts of a slice of ``with_spans`` lie in a span."""
    starts, ends = part.column(3), part.column(4)
    n = pa.compute.fill_null(pa.compute.list_value_length(starts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    base = np.repeat(first[:-1], n)
    return covered(base + starts.flatten().to_numpy(), base + ends.flatten().to_numpy(), int(first[-1]))


def drop_repeated_words(docs: DataFrame, k: int = 50, m: int = M_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, kept (its remaining words).

    A word goes if a window of ``k`` words covers it whose words also start in a document of a smaller
    doc_id.  Null and empty texts, and those of white space, have no words; a null doc_id is the largest;
    rows of one doc_id with different texts count as different documents, ordered by digest, and equal
    rows as one; an empty table gives no rows.
    """
    docs, _ = numbered(docs)
    spans = covered_spans(docs, word_items, lambda blob, _: repeated_windows(blob, k), k, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in unpacked(batches):
            w = Words(data, off, SPACED, hashes=False)
            gone = flags_of(part, w.first)
            raw = data.tobytes()
            kept = []
            for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                at = np.flatnonzero(~gone[a:b]) + a
                kept.append(b" ".join([raw[x:y] for x, y in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]))
            total = np.concatenate(([0], np.cumsum(gone)))
            removed = total[w.first[1:]] - total[w.first[:-1]]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(w.count), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode() for x in kept], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return with_spans(docs, spans).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
