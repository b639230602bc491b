"""Toxic passages as maximum-scoring segments.

Each word scores its log-odds of standing in toxic against clean texts.  The share of toxic texts among those that
hold a word has a Dirichlet prior of one fixed strength, centred on the share of the word's longest prefix, and so
on down to the share among all texts: rare inflections inherit from their stem, unseen words score by what is known
of their beginning.  All scores less a drift make random clean text fall; a linear scan finds every maximal segment
of positive total.  By extreme-value theory the number of segments of score S or more in n clean words is
K n exp(-lambda S); lambda is the root for the scores of clean words, K is fitted to the best segments of clean texts.
A passage is significant if that number is ``LEVEL`` at most.  A document's segments are joined by the sum statistic
of this theory, and a logistic curve turns the logarithm of its chance into a probability.

Whatever is calibrated uses scores that were learned from the other half of the training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import ALNUM, LOWER, Words, block_hash, checkpointed, chunks, keep, mix, spread

#: Labelled rows, and bytes of their texts, that the model is fitted on at most: an even sample by a hash of the id.
FIT_ROWS, FIT_BYTES = 20_000, 64 << 20
#: Bytes of the prefixes that words lean on, longest first.
PREFIXES = (9, 8, 7, 6, 5, 4)
#: Strength of the prior in texts, and what every word's log-odds are lowered by.
PRIOR, DRIFT = 4.0, 0.7
#: Chance segments expected in a clean text from which on a passage is no longer significant.
LEVEL = 0.05


class Model(NamedTuple):
    key: np.ndarray  # sorted hashes of words and prefixes
    weight: np.ndarray  # their log-odds
    rate: float  # lambda
    k: float
    bias: float
    slope: float


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hashes of lower-case words and of their prefixes, 0 where a word is no longer than the prefix."""
    out = [mix(block_hash(data, start, end), 20)]
    for n in PREFIXES:
        h = mix(block_hash(data, start, np.minimum(end, start + n), n), 20 + n)
        out.append(np.where(end - start > n, h, np.uint64(0)))
    return out


def _scores(model: Model, data: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray]:
    """Score of each word: its own log-odds if it was seen, else those of its longest seen prefix; less the drift."""
    low = LOWER[data]
    w = Words(low, off, ALNUM)
    _, one, which = np.unique(w.hash, return_index=True, return_inverse=True)
    out = np.zeros(len(one))
    if len(model.key):
        for h in features(low, w.start[one], w.end[one])[::-1]:
            at = np.minimum(np.searchsorted(model.key, h), len(model.key) - 1)
            out = np.where((model.key[at] == h) & (h != 0), model.weight[at], out)
    return w, (out - DRIFT)[which]


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) of a sequence, in one pass over its positive runs."""
    if not len(scores):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    good = scores > 0
    edge = np.diff(np.concatenate(([0], good.astype(np.int8), [0])))
    found: list[list[float]] = []  # left total, right total, start, end
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        now = [float(total[a]), float(total[b]), a, b]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= now[0]:
                j -= 1
            if j < 0 or found[j][1] >= now[1]:
                found.append(now)
                break
            now = [found[j][0], now[1], found[j][2], now[3]]
            del found[j:]
    return [(r - l, int(a), int(b)) for l, r, a, b in found]


def _discounted(scores: np.ndarray, words: np.ndarray) -> float:
    """Share of a passage's positive scores that counts as evidence: the j-th occurrence of a word weighs a j-th, so
    that no repeat rules."""
    good = scores > 0
    scores, words = scores[good], words[good]
    order = np.argsort(words, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = words[order][1:] != words[order][:-1]
    at = np.arange(len(order))
    nth = at - at[new][np.cumsum(new) - 1] + 1
    return float((scores[order] / nth).sum() / scores.sum())


def _passages(scores: np.ndarray, words: np.ndarray) -> list[tuple[float, float, int, int]]:
    """(evidence, score, start, end) of all maximal segments of one text."""
    if not (scores > 0).any():
        return []
    return [(s * _discounted(scores[a:b], words[a:b]) if b - a > 1 else s, s, a, b) for s, a, b in segments(scores)]


def joined(normal: list[float]) -> float:
    """Minus the logarithm of the chance of the best sum of the first r normalised scores (lambda S - ln(K n)),
    over all r; each further segment costs a factor of two.  0 for no evidence."""
    best, total = 0.0, 0.0
    for r, s in enumerate(sorted(normal, reverse=True), 1):
        if s <= 0:
            break
        total += s
        best = max(best, total - (r - 1) * log(max(total, 1.0)) + lgamma(r + 1) + lgamma(r) - r * log(2))
    return best


def _evidence(model: Model, scores: np.ndarray, words: np.ndarray) -> tuple[float, list[tuple[float, int, int]]]:
    """The joined evidence of a text, and (score, start, end) of its significant passages."""
    found = _passages(scores, words)
    chance = log(model.k * len(scores)) if found else 0.0
    x = joined([model.rate * e - chance for e, *_ in found])
    return float(np.log1p(x)), [(model.rate * s - chance, a, b) for _, s, a, b in found if model.rate * s - chance >= -log(LEVEL)]


def _rows(model: Model, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list]:
    w, scores = _scores(model, data, off)
    found = [_evidence(model, scores[a:b], w.hash[a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return np.array([f[0] for f in found]), [f[1] for f in found]


def _lambda(values: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * value)) = 1."""
    lo, hi = 1e-6, 1.0
    f = lambda x: float(np.sum(share * np.exp(np.minimum(x * values, 700)))) - 1
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and non-negative slope by penalised Newton steps."""
    b = np.array([-1.0, 0.5])
    a = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (y - p) - np.array([0.0, 0.1]) * b
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, 0.1])
        step = np.linalg.solve(hess, grad)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(max(b[1], 0.0))


def log_odds(parent: np.ndarray, y: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """Log-odds of words and prefixes from the numbers of toxic and clean texts that hold them; ``parent``: place of
    each one's longest prefix, -1 for none."""
    mean = np.full(len(y), share)
    depth, up = np.zeros(len(y), np.int64), parent
    while (up >= 0).any():  # how many prefixes lie below
        depth += up >= 0
        up = np.where(up >= 0, parent[up], -1)
    for d in range(int(depth.max(initial=0)) + 1):
        sel = np.flatnonzero(depth == d)
        prior = np.where(parent[sel] >= 0, mean[parent[sel]], share)
        mean[sel] = (y[sel] + PRIOR * prior) / (y[sel] + n[sel] + PRIOR)
    return np.log(mean / (1 - mean)) - log(share / (1 - share))


def _sample(docs: DataFrame, labels: DataFrame, rows: int, size: int) -> DataFrame:
    """(text, label, fold) of at most ``rows`` labelled documents and ``size`` bytes of text, in the order of a hash
    of the id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    place = F.xxhash64("doc_id").alias("place")
    chosen = known.select("doc_id", F.col("label").cast("int").alias("label"), place).orderBy("place", "doc_id").limit(rows)
    docs = keep(docs, "doc_id", "text")
    # Only ids and sizes, ``rows`` of them at most (and their repeats' sums), come together to find the last one.
    sizes = docs.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size")).join(F.broadcast(chosen), "doc_id")
    total = sizes.withColumn("total", F.sum("size").over(Window.orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    last = total.where(F.col("total") > size).agg(F.min("place")).first()[0]
    if last is not None:
        chosen = chosen.where(F.col("place") < last)
    train = docs.join(F.broadcast(chosen), "doc_id")
    return checkpointed(train.select(F.coalesce("text", F.lit("")).alias("text"), "label", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).cast("int").alias("fold")))


def _counted(train: DataFrame) -> pa.Table:
    """Of every word and prefix: kind, longest prefix, and the toxic and clean texts of both folds that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in chunks(batches, limit=8 << 20):
            cell = (part.column(1).to_numpy() + 2 * part.column(2).to_numpy()).astype(np.int64)
            low = LOWER[data]
            w = Words(low, off, ALNUM)
            text = np.repeat(np.arange(len(cell)), w.count)
            _, one, which = np.unique(w.hash, return_index=True, return_inverse=True)
            hashes = np.stack(features(low, w.start[one], w.end[one]))
            up = np.zeros_like(hashes)  # the longest prefix of each feature
            for i in range(len(hashes) - 1, -1, -1):
                for j in range(len(hashes) - 1, i, -1):
                    up[i] = np.where(hashes[j] != 0, hashes[j], up[i])
            pairs = np.unique(np.stack((text, which)), axis=1)  # a word counts once in a text
            h, parent = hashes[:, pairs[1]].ravel(), up[:, pairs[1]].ravel()
            text = np.tile(pairs[0], len(hashes))[h != 0]
            parent, h = parent[h != 0], h[h != 0]
            order = np.lexsort((text, h))
            h, text, parent = h[order], text[order], parent[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            h, text, parent = h[new], text[new], parent[new]
            u, first, inv = np.unique(h, return_index=True, return_inverse=True)
            n = np.bincount(inv * 4 + cell[text], minlength=4 * len(u)).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(parent[first].view(np.int64)), *(pa.array(n[:, i].astype(np.int32)) for i in range(4))], ["h", "parent", "n0", "y0", "n1", "y1"])

    counts = train.mapInArrow(count, "h long, parent long, n0 int, y0 int, n1 int, y1 int").groupBy("h").agg(F.max("parent").alias("parent"), *(F.sum(c).cast("int").alias(c) for c in ("n0", "y0", "n1", "y1")))
    # Bounded by the sample: one row for each word and prefix of ``FIT_BYTES`` at most.
    return counts.toArrow()


def _nothing(share: float) -> Model:
    return Model(np.zeros(0, np.uint64), np.zeros(0, np.float32), 1.0, 1.0, log((share + 1e-3) / (1 - share + 1e-3)), 0.0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Model:
    """Fit on the labelled rows (``labels``: doc_id, toxic) of at most ``rows`` documents with ``size`` bytes of text,
    spread evenly by a hash of the id.  Rows with a null label or id or without a document are not used; a null
    text counts as empty; without labels of both kinds every text gets the share of the one kind as its score."""
    spark = docs.sparkSession
    train = _sample(docs, labels, rows, size)
    texts = {(r.fold, r.label): r.n for r in train.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, all_ = sum(n for (_, y), n in texts.items() if y), sum(texts.values())
    if not all_ or toxic in (0, all_):
        return _nothing(toxic / max(all_, 1))
    table = _counted(train)
    key = table.column("h").to_numpy().view(np.uint64)
    order = np.argsort(key)
    key, up = key[order], table.column("parent").to_numpy().view(np.uint64)[order]
    n0, y0, n1, y1 = (table.column(c).to_numpy()[order].astype(np.float64) for c in ("n0", "y0", "n1", "y1"))
    at = np.minimum(np.searchsorted(key, up), len(key) - 1)
    parent = np.where((up != 0) & (key[at] == up), at, -1) if len(key) else at
    del table, up, at, order

    def learned(y: np.ndarray, n: np.ndarray, folds: tuple) -> Model:
        bad, both = (sum(c for (f, label), c in texts.items() if f in folds and (label or not b)) for b in (True, False))
        share = min(max(bad / max(both, 1), 0.5 / all_), 1 - 0.5 / all_)
        return Model(key, log_odds(parent, y, n, share).astype(np.float32), 1.0, 1.0, 0.0, 1.0)

    whole = learned(y0 + y1, n0 + n1, (0, 1))
    others = spark.sparkContext.broadcast((learned(y1, n1, (1,)), learned(y0, n0, (0,))))  # for rows of fold 0 and 1

    def by_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part, data, off in chunks(batches):
            fold, label = part.column(2).to_numpy(), part.column(1).to_numpy()
            for f in np.unique(fold).tolist():
                at = np.flatnonzero(fold == f)
                own = data[spread(off[:-1][at], np.diff(off)[at])]
                w, scores = _scores(others.value[f], own, np.concatenate(([0], np.cumsum(np.diff(off)[at]))))
                yield label[at], w, scores

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, w, scores in by_fold(batches):
            u, n = np.unique(np.round(scores[np.repeat(label, w.count) == 0] * 16).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["cell", "n"])

    seen = train.mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # some hundred cells
    values, share = seen["cell"].to_numpy() / 16, seen["n"].to_numpy().astype(np.float64)
    rate = _lambda(np.append(values, 4.0), np.append(share, 0.5) / (share.sum() + 0.5))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, w, scores in by_fold(batches):
            top = [max((e for e, *_ in _passages(scores[a:b], w.hash[a:b])), default=0.0) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
            sel = (label == 0) & (w.count > 0)
            yield pa.RecordBatch.from_arrays([pa.array(w.count[sel]), pa.array(np.array(top)[sel])], ["n", "top"])

    clean = train.mapInArrow(best, "n long, top double").select((F.col("n") * F.exp(-rate * F.col("top"))).alias("x")).agg(F.count("x"), F.sum("x")).first()
    shape = whole._replace(rate=rate, k=max(float(clean[0] / clean[1]) if clean[1] else 1.0, 1e-6))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, w, scores in by_fold(batches):
            x = [_evidence(small, scores[a:b], w.hash[a:b])[0] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), pa.array(label.astype(np.float64))], ["x", "y"])

    small = shape._replace(key=np.zeros(0, np.uint64), weight=np.zeros(0, np.float32))
    pairs = train.mapInArrow(again, "x double, y double").toPandas()  # at most ``rows`` pairs of numbers
    bias, slope = _logistic(pairs["x"].to_numpy(), pairs["y"].to_numpy())
    others.unpersist()
    return shape._replace(bias=bias, slope=slope)


def _chance(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.bias + model.slope * x, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, passages array<struct<start, end, score>> (in words; the score is normalised).  Null
    and empty texts have no passages and the score of clean ones; repeated rows are scored each; an empty table gives
    no rows.  Only ``doc_id`` and ``text`` are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, data, off in chunks(batches):
            x, found = _rows(m, data, off)
            p = _chance(m, x)
            passages = [[{"start": a, "end": b, "score": float(s)} for s, a, b in f] for f in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(passages, pa.list_(item))], ["doc_id", "score", "predicted", "passages"])

    return keep(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, passages array<struct<start:long,end:long,score:double>>")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose score is below one half, with all columns.  Null and empty texts stay; repeated rows are judged
    each; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, data, off in chunks(batches):
            yield part.filter(pa.array(_chance(m, _rows(m, data, off)[0]) < 0.5))

    return docs.mapInArrow(run, docs.schema)
