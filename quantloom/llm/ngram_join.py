"""Jaccard join on word n-grams by rare-first prefix filtering.

Shingles are ordered by document frequency, rarest first, as counted in hashed cells over all texts; ties
go by hash.  Two sets that are similar share one of their first shingles, so
only these are joined.  Candidates must pass filters on the lengths, on the positions of their first shared
shingle, and on the suffixes behind it: these are parted into classes by hash, and the sizes of the classes bound how
much both can share.  Each pair that is left is verified once, by bounds from hash counts of the whole sets and then
on the whole texts.

Groups of copies do not yield all their pairs: equal sets are linked by their digest; in a first round
only the members of a shared shingle and its first and last documents are verified; in the second round only pairs
that were not verified yet and that the links so far do not connect.  So no link between components is lost.  All links lie within components, so
their numbers are counted there: each two different sets of a component are compared once, in tiles of two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._superkmers import numbered
from ._text import CHUNK, LOWER, SPACED, Words, chunks, discard, flat, gram_hash, mix, packed, partitions, sequence_hash, shared_dir, spread, windows

#: Cells in which documents of shingles are counted, a bounded array that is broadcast, and its slices.
COUNTED, SLICES = 1 << 22, 64
#: Cells of the hash counts of whole sets, and classes of the suffixes.
CELLS, PARTED = 32, 4
#: Prefix entries that a task gathers before it sends them.
FLUSH = 500_000
#: One in so many shingles takes part in the first round.
FIRST = 8
#: Sets and shingles of a block of a component, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted, and the size of each set."""
    w = Words(LOWER[data], off, SPACED)
    at, many = windows(w.first, n)
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    few = w.count[short]
    text = np.concatenate((np.repeat(np.arange(len(many)), many), short))
    hashes = np.concatenate((gram_hash(w.hash, n, 7)[at], sequence_hash(w.hash[spread(w.first[short], few)], np.concatenate(([0], np.cumsum(few))), 8)))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    text, hashes = text[new], hashes[new]
    return text, hashes, np.bincount(text, minlength=len(many))


class Rule:
    """Link if 100 * common >= percent * union."""

    def __init__(self, n: int, percent: int):
        self.n, self.percent = n, percent

    def prefix(self, size: np.ndarray) -> np.ndarray:
        return np.where(size > 0, size + 1 + (-self.percent * size) // 100, 0)

    def need(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least number of common shingles of sets of these sizes."""
        return -((-self.percent * (a + b)) // (100 + self.percent))

    def may(self, a, pos_a, b, pos_b) -> np.ndarray:
        """Length filter, and positional filter at the first shared shingle."""
        return (100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)) & (1 + np.minimum(a - pos_a, b - pos_b) - 1 >= self.need(a, b))

    def suffixes(self, a, pos_a, parts_a, b, pos_b, parts_b) -> np.ndarray:
        """Suffix filter at the first shared shingle: shingles behind it that only one set has are as many at least as
        the classes of both suffixes differ by, and as many at most as the needed ones leave."""
        differ = sum(np.abs(x - y) for x, y in zip(parts_a, parts_b, strict=True))
        return differ <= (a - pos_a - 1) + (b - pos_b - 1) - 2 * (self.need(a, b) - 1)


def _profiles(docs: DataFrame, rule: Rule) -> DataFrame:
    """Of each text its set's size, digest and hash counts (kind 0), and of each task the numbers of documents in
    slices of the counted cells (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(COUNTED, np.uint32)
        for part, data, off in chunks(batches):
            text, h, size = shingles(data, off, rule.n)
            one, two = (_sum_by(mix(h, s), size) for s in (31, 32))
            cells = np.bincount(text * CELLS + (h % np.uint64(CELLS)).astype(np.int64), minlength=len(size) * CELLS).reshape(-1, CELLS)
            counted = [x.tobytes() for x in np.minimum(cells, 65535).astype("<u2")]
            yield batch(np.zeros(len(size), np.int8), part.column(0), part.column(1), size, one.view(np.int64), two.view(np.int64), counted)
            np.add.at(times, (h >> np.uint64(40)).astype(np.int64) % COUNTED, 1)
        slices = [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in times.reshape(SLICES, -1)]
        yield batch(np.ones(SLICES, np.int8), pa.array(np.arange(SLICES)), pa.nulls(SLICES, pa.int64()), *[np.zeros(SLICES, np.int64)] * 3, slices)

    def batch(*columns) -> pa.RecordBatch:
        kinds = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(columns, kinds, strict=True)], ["kind", "key", "doc_id", "n", "one", "two", "cells"])

    return docs.select("key", "doc_id", "text").mapInArrow(run, "kind byte, key long, doc_id long, n long, one long, two long, cells binary")


def _sum_by(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of consecutive groups of the given sizes."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    end = np.cumsum(size)
    return total[end] - total[end - size]


def _counts(stored: DataFrame) -> np.ndarray:
    """Number of documents of each counted cell, slices summed in parallel."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(COUNTED // SLICES, np.uint32)
        for x in table.column("cells"):
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.uint32)
        return pa.table({"key": table.column("key").slice(0, 1), "cells": pa.array([total.tobytes()], pa.binary())})

    rows = stored.where("kind = 1").select("key", "cells").groupBy("key").applyInArrow(add, "key long, cells binary").collect()  # SLICES rows
    out = np.zeros((SLICES, COUNTED // SLICES), np.uint32)
    for r in rows:
        out[r.key] = np.frombuffer(r.cells, np.uint32)
    return out.ravel()


_ENTRY = (np.uint64, np.uint64, np.uint64, np.int64, np.int32, np.int32, *[np.int32] * PARTED)
_CLASSES = [f"c{i}" for i in range(PARTED)]


def _distinct_sets(h, one, two, key, n, *more) -> tuple[np.ndarray, ...]:
    """Entries sorted by shingle; of equal sets with one shingle that of the least key."""
    order = np.lexsort((key, n, two, one, h))
    h, one, two, key, n, *more = (x[order] for x in (h, one, two, key, n, *more))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (n[1:] != n[:-1])
    return tuple(x[new] for x in (h, one, two, key, n, *more))


def _entries(docs: DataFrame, rule: Rule, counts: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, blob) of the prefix entries: shingle, both digests of the set, key, size, position, and the classes'
    sizes of the suffix behind it."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        held: list[tuple] = []
        size = 0
        for part, data, off in chunks(batches):
            text, h, n = shingles(data, off, rule.n)
            order = np.lexsort((h, counts[(h >> np.uint64(40)).astype(np.int64) % COUNTED], text))
            h = h[order]
            one, two = (_sum_by(mix(h, s), n) for s in (31, 32))
            end = np.repeat(np.cumsum(n), n)
            pos = np.arange(len(h)) - end + np.repeat(n, n)
            sel = np.flatnonzero(pos < np.repeat(rule.prefix(n), n))
            own = text[sel]
            keys = part.column(0).to_numpy(zero_copy_only=False)
            behind = []
            for c in range(PARTED):
                total = np.concatenate(([0], np.cumsum((h >> np.uint64(8)) % np.uint64(PARTED) == c)))
                behind.append(total[end[sel]] - total[sel + 1])
            held.append((h[sel], one[own], two[own], keys[own], n[own], pos[sel], *behind))
            size += len(own)
            if size > FLUSH:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        columns = _distinct_sets(*(np.concatenate(x) for x in zip(*held, strict=True)))
        bucket = (mix(columns[0], 5) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [x[order] for x in columns]
        edge = np.flatnonzero(np.diff(bucket, prepend=-1))
        out = []
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)], strict=True):
            own = [np.diff(columns[0][a:b], prepend=np.uint64(0)), *(x[a:b] for x in columns[1:])]
            out.append(zstandard.ZstdCompressor(level=3).compress(b"".join([np.int64(b - a).tobytes(), *(x.astype(t).tobytes() for x, t in zip(own, _ENTRY, strict=True))])))
        return pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int32)), pa.array(out, pa.binary())], ["bucket", "blob"])

    return docs.select("key", "text").mapInArrow(run, "bucket int, blob binary")


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    out = []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        count, at, columns = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
        for kind in _ENTRY:
            columns.append(np.frombuffer(raw, kind, count, at))
            at += columns[-1].nbytes
        out.append((np.cumsum(columns[0], dtype=np.uint64), *columns[1:]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _shared(entries: DataFrame) -> DataFrame:
    """Entries of shingles that several different sets have in their prefix: (h, key, n, pos, classes)."""

    def run(table: pa.Table) -> pa.Table:
        h, _, _, *rest = _distinct_sets(*_unpack([x.as_py() for x in table.column("blob")]))
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        many = ~(first & np.append(first[1:], True))
        return pa.table([pa.array(h[many].view(np.int64)), *(pa.array(x[many].astype(np.int64)) for x in rest)], names=["h", "key", "n", "pos", *_CLASSES])

    schema = ", ".join(f"{c} long" for c in ("h", "key", "n", "pos", *_CLASSES))
    return entries.repartition(partitions(entries.sparkSession), "bucket").groupBy("bucket").applyInArrow(run, schema)


def _stars(members: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of the first and the last document of a shingle with each other one, from a share of the
    shingles.  The positional filter holds at the first shared shingle only, so here just lengths count."""
    some = members.where(F.pmod(F.xxhash64("h"), F.lit(FIRST)) == 0)
    hubs = some.groupBy("h").agg(F.min(F.struct("key", "n")).alias("lo"), F.max(F.struct("key", "n")).alias("hi"))
    met = some.join(hubs, "h").select("key", "n", F.explode(F.array("lo", "hi")).alias("hub")).where("key != hub.key")
    p = rule.percent
    near = met.where(f"100 * least(n, hub.n) >= {p} * greatest(n, hub.n)")
    return near.select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b")).distinct()


def _crossing(members: DataFrame, labels: DataFrame, tried: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of one shingle that pass the filters, that no link connects so far, and that were not ``tried`` yet."""
    named = members.join(labels, "key", "left").select("h", "key", "n", "pos", *_CLASSES, F.coalesce("label", "key").alias("label"))
    mixed = named.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("h")

    def run(table: pa.Table) -> pa.Table:
        """Many shingles at once.  Documents outside the largest class of their shingle meet all of its documents,
        in blocks of bounded size."""
        h, n, key, pos, label, *parts = (table.column(c).to_numpy() for c in ("h", "n", "key", "pos", "label", *_CLASSES))
        order = np.lexsort((label, h))
        h, n, key, pos, label, *parts = (x[order] for x in (h, n, key, pos, label, *parts))
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        part = new.copy()
        part[1:] |= label[1:] != label[:-1]
        first, at = np.flatnonzero(new), np.flatnonzero(part)
        size, group = np.diff(np.append(first, len(h))), np.cumsum(new) - 1
        many = np.diff(np.append(at, len(h)))
        top = np.maximum.reduceat(many, np.searchsorted(at, first))
        largest = many == top[group[at]]
        largest[1:] &= ~((group[at][1:] == group[at][:-1]) & (np.cumsum(largest)[:-1] > (np.cumsum(largest) - largest)[np.searchsorted(group[at], group[at][1:])]))
        rest = np.flatnonzero(~np.repeat(largest, many))
        out = [np.zeros((2, 0), np.int64)]
        step = np.cumsum(size[group[rest]])
        cuts = np.unique(np.searchsorted(step, np.arange(0, int(step[-1]) if len(step) else 0, 1 << 20))) if len(rest) else []
        for x, y in zip(cuts, [*cuts[1:], len(rest)], strict=True):
            i = rest[x:y]
            one, other = np.repeat(i, size[group[i]]), spread(first[group[i]], size[group[i]])
            ok = (label[one] != label[other]) & rule.may(n[one], pos[one], n[other], pos[other])
            one, other = one[ok], other[ok]
            ok = rule.suffixes(n[one], pos[one], [x[one] for x in parts], n[other], pos[other], [x[other] for x in parts])
            one, other = key[one[ok]], key[other[ok]]
            out.append(np.unique(np.stack([np.minimum(one, other), np.maximum(one, other)]), axis=1))
        a, b = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.table({"a": a, "b": b})

    bucket = F.pmod(F.xxhash64("h"), F.lit(4 * partitions(members.sparkSession)))
    found = named.join(mixed, "h").withColumn("bucket", bucket).groupBy("bucket").applyInArrow(run, "a long, b long").distinct()
    return found.join(tried, ["a", "b"], "left_anti")


def _verified(pairs: DataFrame, profiles: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Links (u, v) among the pairs: hash counts bound the distance first, then whole sets are compared."""
    cells = profiles.select("key", "n", "cells").dropDuplicates(["key"])
    side = lambda s: cells.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("cells").alias(f"cells_{s}"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, na, nb = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("a", "b", "n_a", "n_b"))
            x, y = (flat(batch.column(batch.schema.get_field_index(c)))[0].view("<u2").reshape(-1, CELLS).astype(np.int64) for c in ("cells_a", "cells_b"))
            ok = np.abs(x - y).sum(axis=1) <= na + nb - 2 * rule.need(na, nb)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for whole in batches:
            sizes = np.array([sum(zstandard.frame_content_size(x.as_py()) for x in pair) for pair in zip(whole.column(2), whole.column(3), strict=True)], np.int64)
            ends, at = np.concatenate(([0], np.cumsum(sizes))), 0
            while at < whole.num_rows:  # by the bytes of the texts
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
                batch, at = whole.slice(at, to - at), to
                a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                blobs = dict(zip(a.tolist(), batch.column(2), strict=True)) | dict(zip(b.tolist(), batch.column(3), strict=True))
                keys = np.array(sorted(blobs), np.int64)
                data, off = flat(pa.array([unpacker.decompress(blobs[k].as_py()) for k in keys.tolist()], pa.large_binary()))
                text, h, size = shingles(data, off, rule.n)
                i, j = np.searchsorted(keys, a), np.searchsorted(keys, b)
                first = np.cumsum(size) - size
                common = np.array([np.intersect1d(h[first[x] : first[x] + size[x]], h[first[y] : first[y] + size[y]], assume_unique=True).size for x, y in zip(i, j, strict=True)], np.int64)
                ok = (100 * common >= rule.percent * (size[i] + size[j] - common)) & (common > 0)
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["u", "v"])

    left = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "cells_a", "cells_b").mapInArrow(near, "a long, b long")
    own = lambda s: texts.select(F.col("key").alias(s), F.col("packed").alias(f"packed_{s}"))
    return left.join(own("a"), "a").join(own("b"), "b").select("a", "b", "packed_a", "packed_b").mapInArrow(verify, "u long, v long")


def _tiles(sets: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """(bucket, label, lo, hi, block, key, many, packed): the sets of each component with several of them, dealt into
    blocks by hash, once for each tile (lo, hi) that the block belongs to."""
    named = sets.withColumnRenamed("v", "key").join(labels, "key", "left").select("key", "n", "many", F.coalesce("label", "key").alias("label"))
    crowd = named.groupBy("label").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total")).where("sets > 1")
    blocks = crowd.select("label", F.ceil(F.greatest(F.col("sets") / BLOCK, F.col("total") / BLOCK_SHINGLES)).alias("blocks"))
    own = named.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    tiled = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = tiled.select("label", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "key", "many")
    bucket = F.pmod(F.xxhash64("label", "lo", "hi"), F.lit(4 * partitions(texts.sparkSession)))
    return tiled.join(texts, "key").select(bucket.alias("bucket"), "label", "lo", "hi", "block", "key", "many", "packed")


def _numbers(tiles: DataFrame, rule: Rule) -> DataFrame:
    """(v, others): the documents of other sets that link with each set, all pairs of each tile compared."""

    def run(table: pa.Table) -> pa.Table:
        label, lo, hi, block, key, many = (table.column(c).to_numpy() for c in ("label", "lo", "hi", "block", "key", "many"))
        order = np.lexsort((key, block, hi, lo, label))
        label, lo, hi, block, key, many = (x[order] for x in (label, lo, hi, block, key, many))
        blobs, unpacker = table.column("packed").take(pa.array(order)), zstandard.ZstdDecompressor()
        new = np.ones(len(label), bool)
        new[1:] = (label[1:] != label[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        edges = np.append(np.flatnonzero(new), len(label))
        sizes = np.concatenate(([0], np.cumsum([zstandard.frame_content_size(x.as_py()) for x in blobs])))
        links, tile = np.zeros(len(label), np.int64), 0
        while tile < len(edges) - 1:  # whole tiles, by the bytes of the texts
            to = max(tile + 1, int(np.searchsorted(sizes[edges], sizes[edges[tile]] + CHUNK, "right")) - 1)
            begin, end = int(edges[tile]), int(edges[to])
            data, off = flat(pa.array([unpacker.decompress(x.as_py()) for x in blobs.slice(begin, end - begin)], pa.large_binary()))
            _, h, size = shingles(data, off, rule.n)
            first = np.concatenate(([0], np.cumsum(size)))
            for x, y in zip((edges[tile:to] - begin).tolist(), (edges[tile + 1 : to + 1] - begin).tolist(), strict=True):
                at = slice(begin + x, begin + y)
                compare(h[first[x] : first[y]], size[x:y], block[at], bool(lo[begin + x] != hi[begin + x]), many[at], links[at])
            tile = to
        return pa.table({"v": key, "others": links})

    def compare(h: np.ndarray, size: np.ndarray, block: np.ndarray, two: bool, many: np.ndarray, links: np.ndarray) -> None:
        """Of two blocks each set of one meets all of the other; of one block each meets those behind it."""
        ids = np.unique(h, return_inverse=True)[1]
        first = np.concatenate(([0], np.cumsum(size)))
        has = np.zeros(len(h), np.int32)
        half = int(np.searchsorted(block, block[0], "right"))
        for i in range(half if two else len(size) - 1):
            s = half if two else i + 1
            if s == len(size):
                break
            mine = ids[first[i] : first[i + 1]]
            has[mine] = 1
            common = np.add.reduceat(has[ids[first[s] :]], first[s:-1] - first[s])
            has[mine] = 0
            ok = (100 * common >= rule.percent * (size[i] + size[s:] - common)) & (common > 0)
            links[i] += many[s:][ok].sum()
            links[s:][ok] += many[i]

    return tiles.groupBy("bucket").applyInArrow(run, "v long, others long").groupBy("v").agg(F.sum("others").alias("others"))


def classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach), n_links (0 for
    none, else the number of all other documents that link with it, those with equal sets too).

    Null and empty texts and those of white space have no shingles and link with nothing; a text of fewer
    than ``n`` words has one.  A null doc_id is the largest; rows of one doc_id with different texts are
    different documents, equal rows are one; an empty table gives no rows.
    """
    keyed, plain = numbered(docs)
    out = _classes(keyed, n, percent, count=True)
    if not plain:
        names = keyed.select(F.col("key").alias("component"), F.col("doc_id").alias("named")).dropDuplicates(["component"])
        return out.join(names, "component").select("doc_id", "n_shingles", F.col("named").alias("component_id"), "n_links")
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "n_links")


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of one document of each class, that with the smallest doc_id, with all columns.  Of equal rows
    one stays; nulls as in ``classes``."""
    keyed, plain = numbered(docs)
    stay = _classes(keyed, n, percent).where("key = component").select("key").distinct()
    if plain:
        return docs.join(stay.withColumnRenamed("key", "doc_id"), "doc_id", "left_semi").select(*docs.columns)
    clash = [c for c in docs.columns if c not in ("doc_id", "text")]
    safe = docs.select("doc_id", "text", *(F.col(c).alias(f"own_{i}") for i, c in enumerate(clash)))
    kept = numbered(safe, *(f"own_{i}" for i in range(len(clash))))[0].join(stay, "key", "left_semi").dropDuplicates(["key"])
    back = {c: F.col(f"own_{i}").alias(c) for i, c in enumerate(clash)}
    return kept.select(*(back.get(c, F.col(c)) for c in docs.columns))


def _classes(docs: DataFrame, n: int, percent: int, count: bool = False) -> DataFrame:
    """(key, doc_id, n_shingles, component and, if they are counted, n_links) of (key, doc_id, text); component: the
    least key."""
    spark, rule = docs.sparkSession, Rule(n, percent)
    folder = shared_dir(spark, "ngrams")
    _profiles(docs, rule).write.parquet(f"{folder}/profiles")
    stored = spark.read.parquet(f"{folder}/profiles")
    profiles = stored.where("kind = 0")
    counts = _counts(stored)

    total = profiles.agg(F.sum("n")).first()[0] or 0
    buckets = int(max(4 * partitions(spark), total * (100 - percent) // 100 // 250_000))
    _shared(_entries(docs, rule, counts, buckets)).write.parquet(f"{folder}/members")
    members = spark.read.parquet(f"{folder}/members")
    packed(docs.select("key", "text")).join(members.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]).select("key", "packed").write.option("compression", "none").parquet(f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")

    # Written, so that joins of the many copies of one set read tables on both sides and can be split where they are skewed.
    profiles.where("n > 0").groupBy("one", "two", "n").agg(F.min("key").alias("v"), F.countDistinct("key").alias("many")).write.parquet(f"{folder}/sets")
    sets = spark.read.parquet(f"{folder}/sets")
    equal = profiles.select("one", "two", "n", "key").join(sets.where("many > 1"), ["one", "two", "n"]).where("key != v").select(F.col("key").alias("u"), "v")
    _stars(members, rule).write.parquet(f"{folder}/tried")
    tried = spark.read.schema("a long, b long").parquet(f"{folder}/tried")
    _verified(tried, profiles, texts, rule).write.parquet(f"{folder}/links/1")
    links = spark.read.schema("u long, v long").parquet(f"{folder}/links/1").unionByName(equal)
    labels = components(links)
    _verified(_crossing(members, labels, tried, rule), profiles, texts, rule).write.parquet(f"{folder}/links/2")
    more = spark.read.schema("u long, v long").parquet(f"{folder}/links/2")
    if not more.isEmpty():
        # Labels stand for their links, so only the new links are added to them.
        labels = components(labels.select(F.col("key").alias("u"), F.col("label").alias("v")).unionByName(more))
    found = profiles.join(labels, "key", "left").withColumn("component", F.coalesce("label", "key")).withColumnRenamed("n", "n_shingles")
    done = [f"{folder}/{x}" for x in ("members", "tried", "links")]
    if not count:
        discard(spark, *done, f"{folder}/texts")
        return found.select("key", "doc_id", "n_shingles", "component")
    _numbers(_tiles(sets.drop("one", "two"), labels, texts), rule).write.parquet(f"{folder}/numbers")
    discard(spark, *done, f"{folder}/texts")
    numbers = spark.read.schema("v long, others long").parquet(f"{folder}/numbers")
    degree = sets.join(numbers, "v", "left").select("one", "two", F.col("n").alias("n_shingles"), (F.coalesce("others", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    degree.write.parquet(f"{folder}/degree")
    return found.join(spark.read.parquet(f"{folder}/degree"), ["one", "two", "n_shingles"], "left").select("key", "doc_id", "n_shingles", "component", F.coalesce("n_links", F.lit(0)).alias("n_links"))
