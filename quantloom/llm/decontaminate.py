"""Benchmark decontamination by suffix arrays of the training texts.

Each slice of the corpus is a shard with a suffix array over its words.  Every suffix of every test item, from each of
its words to its end, is binary-searched in it, word by word and all at once, as far as anything in the shard still
begins like it.  What is left of the interval after a window's words are its verbatim occurrences with their places.
A suffix's final place among those of the shard also gives the longest match of every training suffix: the nearest
test suffix before or after it shares most with it.  A document lies in one shard, so the corpus is read once for a
block of test items and never shuffled; test sets of any size are taken block by block and joined by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import ALNUM, LOWER, Words, chunks, covered, flat, keep, spread

#: Characters of test items that are broadcast and searched at once, about; each further block is a further pass.
BLOCK = 8 << 20
#: Bytes of training texts that a suffix array spans.
SHARD = 4 << 20


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``ids`` (0 ends a text) by their first ``depth`` items, by prefix doubling;
    only suffixes that are not yet told apart are sorted again."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    nxt = np.append(ids[1:], 0)
    key = (ids.astype(np.uint64) << np.uint64(32)) | nxt.astype(np.uint64)
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    done = 2
    while done < depth:
        group = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank = np.zeros(n + 1, np.int64)
        rank[order] = group + 1
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        who = order[at]
        key = (group[at].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(who + done, n)].astype(np.uint64)
        again = np.argsort(key)
        order[at] = who[again]
        key = key[again]
        new[at[1:]] = key[1:] != key[:-1]
        new[at[0]] = True
        done *= 2
    return order


def narrowed(order: np.ndarray, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each interval [lo, hi) of suffixes whose item ``d`` is the wanted one, by binary search; an empty
    part lies where it would be."""
    n, ends = len(ids), []
    for right in (False, True):
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            at = order[np.minimum(mid, n - 1)] + d
            have = np.where(at < n, ids[np.minimum(at, n - 1)], 0)
            up = open_ & ((have <= want) if right else (have < want))
            a, b = np.where(up, mid + 1, a), np.where(open_ & ~up, mid, b)
        ends.append(a)
    return ends[0], ends[1]


def common(ids: np.ndarray, at: np.ndarray, other: np.ndarray, place: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of first items that the suffixes ``at`` of ``ids`` share with those of ``other`` at ``place``, which end at
    ``end``; 0 in either is unlike anything."""
    out = np.zeros(len(at), np.int64)
    live, d = np.arange(len(at)), 0
    while len(live):
        live = live[(at[live] + d < len(ids)) & (place[live] + d < end[live])]
        one, two = ids[at[live] + d], other[place[live] + d]
        live, d = live[(one == two) & (one > 0)], d + 1
        out[live] = d
    return out


class Tests:
    """Words of the test items, end to end; every word begins a suffix."""

    def __init__(self, item_ids: list, texts: list, k: int):
        data, off = flat(pa.array(texts, pa.string()))
        w = Words(LOWER[data], off, ALNUM)
        self.k, self.ids, self.first = k, list(item_ids), w.first
        self.kinds, self.code = np.unique(w.hash, return_inverse=True)
        n = w.count
        self.item = np.repeat(np.arange(len(n)), n)
        self.end = np.repeat(w.first[1:], n)
        self.longest = int(n.max(initial=0))
        # A window is so many words of a suffix: k, or all of an item of fewer; 0 for suffixes that are none.
        whole = np.arange(len(self.item)) == w.first[self.item] if len(self.item) else np.zeros(0, bool)
        left = self.end - np.arange(len(self.end))
        self.window = np.where(left >= k, k, np.where(whole, left, 0))


class Matches:
    """Verbatim matches of the tests in one shard.

    ``suffix``, ``doc``, ``word``: each occurrence of a window, by its test suffix and its place in the shard.
    ``best``: for each text the words of its longest match with any test suffix, that suffix (-1 for none) and its
    first word in the shard; of equally long ones the first in the text.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, tests: Tests):
        w = Words(LOWER[data], off, ALNUM)
        self.words, docs = w, len(off) - 1
        none = np.zeros(0, np.int64)
        self.suffix = self.doc = self.word = none
        self.best = np.zeros(docs, np.int64), np.full(docs, -1, np.int64), np.full(docs, -1, np.int64)
        if not len(w.hash) or not len(tests.code):
            return
        kinds, dense = np.unique(w.hash, return_inverse=True)
        where = np.minimum(np.searchsorted(kinds, tests.kinds), len(kinds) - 1)
        code = np.where(kinds[where] == tests.kinds, where + 1, 0)  # 0: no such word in the shard
        query = code[tests.code]
        if not query.any():
            return
        # A 0 after each text: matches do not run on into the next.
        ids = np.zeros(len(dense) + docs, np.int64)
        owner = np.repeat(np.arange(docs), w.count)
        place = np.arange(len(dense)) + owner
        ids[place] = dense + 1
        order = suffix_array(ids, tests.longest)
        begins = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=len(kinds) + 1))))
        lo = np.where(query > 0, begins[query], 0)
        hi = np.where(query > 0, begins[query + 1], 0)
        # ``at``: where the suffix itself would stand.  Items go on until nothing in the shard begins alike.
        at, live, d = lo.copy(), np.flatnonzero(query > 0), 1
        hits = []
        while len(live):
            full = live[tests.window[live] == d]
            n = hi[full] - lo[full]
            hits.append((np.repeat(full, n), order[spread(lo[full], n)]))
            live = live[live + d < tests.end[live]]
            want = query[live + d]
            a, b = narrowed(order, ids, lo[live], hi[live], d, want)
            at[live] = a
            on = (b > a) & (want > 0)
            live = live[on]
            lo[live], hi[live], d = a[on], b[on], d + 1
        back = np.full(len(ids), -1, np.int64)
        back[place] = np.arange(len(dense))
        self.suffix, found = (np.concatenate(x) for x in zip(*hits, strict=True))
        self.word = back[found]
        self.doc = owner[self.word] if len(self.word) else self.word
        self._longest(tests, query, ids, order, at, np.isin(dense + 1, code[code > 0]), place, owner)

    def _longest(self, tests: Tests, query, ids, order, at, likely, place, owner) -> None:
        """``likely``: words that occur in tests.  Of the test suffixes that stand at one place, the one that shares most
        with the training suffix before it (after it) stands next to it."""
        n, rank = len(ids), np.empty(len(ids), np.int64)
        rank[order] = np.arange(n)
        suffix = np.flatnonzero(query > 0)
        slot = at[suffix]
        word = np.flatnonzero(likely)
        start, own = place[word], rank[place[word]]
        length, which = np.zeros(len(word), np.int64), np.full(len(word), -1, np.int64)
        for before in (True, False):
            near = np.clip(slot if before else slot - 1, 0, n - 1)
            shared = common(ids, order[near], query, suffix, tests.end[suffix])
            first = np.lexsort((suffix, -shared, slot))
            first = first[np.diff(slot[first], prepend=-1) != 0]
            slots, chosen = slot[first], suffix[first]
            i = np.searchsorted(slots, own, "right") - (1 if before else 0)
            ok = (i >= 0) & (i < len(slots))
            mine = chosen[np.clip(i, 0, len(slots) - 1)]
            m = np.where(ok, common(ids, start, query, mine, tests.end[mine]), 0)
            which, length = np.where(m > length, mine, which), np.maximum(length, m)
        order = np.lexsort((word, -length, owner[word]))
        order = order[np.diff(owner[word][order], prepend=-1) != 0]
        order = order[length[order] > 0]
        for column, values in zip(self.best, (length, which, word), strict=True):
            column[owner[word[order]]] = values[order]


def _blocks(benchmark: DataFrame, k: int) -> tuple[int, Iterator[Tests]]:
    """The test items with any text, dealt into blocks of about ``BLOCK`` characters by a hash: their number, and the
    blocks, of which one is held at a time."""
    items = benchmark.select("item_id", "text").where(F.length("text") > 0).distinct()
    whole = items.agg(F.sum(F.length("text"))).first()[0] or 0
    many = -(-whole // BLOCK) or 1

    def each() -> Iterator[Tests]:
        for b in range(many):
            rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == b).orderBy("item_id", "text").collect()
            yield Tests([r[0] for r in rows], [r[1] for r in rows], k)

    return many, each()


_FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>, longest struct<words:long,item:string,item_word:long,word:long>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_LONGEST = pa.struct([("words", pa.int64()), ("item", pa.string()), ("item_word", pa.int64()), ("word", pa.int64())])


def _searched(data: np.ndarray, off: np.ndarray, tests: Tests) -> list[pa.Array]:
    """The columns of ``_FOUND`` for the texts of one shard; spans of hit words are maximal, items sorted."""
    docs, m = len(off) - 1, Matches(data, off, tests)
    first = m.words.first
    hit = covered(m.word, m.word + tests.window[m.suffix], len(m.words.start))
    edged = np.zeros(len(hit) + docs, np.int8)  # a gap after each text
    owner = np.repeat(np.arange(docs), m.words.count)
    edged[np.arange(len(hit)) + owner] = hit
    edge = np.diff(edged, prepend=0, append=0)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    base = first[:-1] + np.arange(docs)
    text = np.searchsorted(base, a, "right") - 1
    spans: list[list] = [[] for _ in range(docs)]
    for i, x, y in zip(text.tolist(), (a - base[text]).tolist(), (b - base[text]).tolist(), strict=True):
        spans[i].append({"start": x, "end": y})
    items: list[set] = [set() for _ in range(docs)]
    many = max(len(tests.ids), 1)
    for p in np.unique(m.doc * many + tests.item[m.suffix]).tolist():
        doc, item = divmod(p, many)
        if tests.ids[item] is not None:
            items[doc].add(str(tests.ids[item]))
    longest = []
    for i, (n, suffix, word) in enumerate(zip(*(x.tolist() for x in m.best), strict=True)):
        item = int(tests.item[suffix]) if n else -1
        longest.append({"words": n, "item": None if item < 0 or tests.ids[item] is None else str(tests.ids[item]), "item_word": suffix - int(tests.first[item]) if n else None, "word": word - int(first[i]) if n else None})
    return [pa.array(m.words.count), pa.array(spans, _SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(longest, _LONGEST)]


def _digests(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256((x or "").encode()).digest() for x in texts.to_pylist()], pa.binary())


def _joined(docs: DataFrame, many: int, blocks: Iterator[Tests], share: int) -> DataFrame:
    """(doc_id, digest of the text, and what ``_FOUND`` lists) of (doc_id, text), over all blocks, and the verdict."""
    spark, rows = docs.sparkSession, None
    for tests in blocks:
        shared, first = spark.sparkContext.broadcast(tests), rows is None

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first) -> Iterator[pa.RecordBatch]:
            for part, data, off in chunks(batches, limit=SHARD):
                own, n = _searched(data, off, shared.value), len(off) - 1
                digest = _digests(part.column(1)) if many > 1 else pa.array([b""] * n, pa.binary())
                out = pa.RecordBatch.from_arrays([part.column(0), digest, pa.array(np.full(n, first)), *own], ["doc_id", "digest", "base", "n_words", "spans", "items", "longest"])
                yield out if first else out.filter(pa.compute.greater(pa.compute.struct_field(out.column(6), "words"), 0))

        part = docs.mapInArrow(run, f"doc_id long, digest binary, base boolean, {_FOUND}")
        rows = part if rows is None else rows.unionByName(part)
    if many > 1:  # what the blocks found of one document is joined; equal rows are counted by the first block
        rows = rows.groupBy("doc_id", "digest").agg(
            F.sum(F.col("base").cast("int")).alias("rows"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"),
        ).select("*", F.explode(F.sequence(F.lit(1), "rows")))
    hit = F.expr("aggregate(spans, named_struct('to', 0L, 'n', 0L), (a, s) -> named_struct('to', greatest(a.to, s.end), 'n', a.n + greatest(0L, s.end - greatest(a.to, s.start))), a -> a.n)")
    return rows.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def judge(docs: DataFrame, benchmark: DataFrame, k: int = 13, share: int = 20) -> DataFrame:
    """Per document: words, words inside an occurrence of a window of a test item, the items, the longest
    verbatim match of any number of words with its places, and whether a ``share``-th of its words at least are hit.

    A window is ``k`` consecutive words of an item; an item of fewer words, but not none, is one.  Null
    and empty texts have no words and are clean; a null item_id hits words but is in no list; repeated
    rows are judged each; empty tables give no rows, or no hits.  Only ``doc_id`` and ``text`` are read.
    """
    rows = _joined(keep(docs, "doc_id", "text"), *_blocks(benchmark, k), share)
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
        F.col("longest.words").alias("longest_words"), F.col("longest.item").alias("longest_item"), F.col("longest.item_word").alias("longest_item_word"), F.col("longest.word").alias("longest_word"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, k: int = 13, share: int = 20) -> DataFrame:
    """The table without contaminated documents; all columns and other rows as they are.  Nulls, empty texts, repeats
    and empty tables as in ``judge``: documents without words stay."""
    many, blocks = _blocks(benchmark, k)
    if many > 1:
        bad = _joined(keep(docs, "doc_id", "text"), many, blocks, share).where("contaminated").select("digest").distinct()
        digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
        return docs.join(bad.withColumnRenamed("digest", "bad_digest"), digest == F.col("bad_digest"), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(next(blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches, limit=SHARD):
            n_words, spans, _, _ = _searched(data, off, shared.value)
            hit = np.array([sum(x["end"] - x["start"] for x in row) for row in spans.to_pylist()], np.int64)
            yield rows.filter(pa.array((hit == 0) | (share * hit < n_words.to_numpy())))

    return docs.mapInArrow(run, docs.schema)
