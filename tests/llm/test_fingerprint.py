import hashlib

import numpy as np
from conftest_llm import rows

from quantloom.llm import contracts, fingerprint


def edited(docs):
    """(doc_id, n_chars, edited text) by descending id, ties by text; null ids last."""
    docs = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(docs):
        text, follows = text or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(text) // 2
        out.append((doc_id, len(text), hashlib.sha256((text[: len(text) - half] + follows[:half]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_query(spark, sf, real):
    got = contracts.op1_fingerprint(spark, sf)
    assert rows(got.select("doc_id", "n_chars", "edited_sha256")) == edited([(r.doc_id, r.text) for r in real.collect()])
    by = got.toPandas().merge(real.select("doc_id", "text").toPandas(), on="doc_id")
    assert by.groupby("text")["fingerprint"].nunique().max() == 1
    assert (by["near_edited"] > by["near_next"]).mean() > 0.9 and by[["near_edited", "near_next"]].stack().between(0, 1).all()


def test_odd_rows(spark, odd, empty, clash):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    for df in (odd, clash):
        assert rows(fingerprint.versions(df).select("doc_id", "n_chars", "edited_sha256")) == edited(docs)
    assert fingerprint.versions(empty).count() == 0
    more = [(None, "a"), (None, "b b"), (3, "c c c"), (3, "c c c"), (-9, None)]
    df = spark.createDataFrame(more, "doc_id long, text string")
    assert rows(fingerprint.versions(df).select("doc_id", "n_chars", "edited_sha256")) == edited(more)
    one = fingerprint.versions(spark.createDataFrame([(1, "x y z")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_differences_are_exact():
    rng = np.random.default_rng(2)
    own = [set(rng.integers(1, 400, n).tolist()) for n in (0, 3, 40, 300, 300)]
    other = [set(rng.integers(1, 400, n).tolist()) for n in (0, 5, 40, 10, 300)]

    def pack(sets):
        text = np.concatenate([np.full(len(s), i) for i, s in enumerate(sets)]).astype(np.int64)
        key = fingerprint.mix(np.concatenate([np.array(sorted(s), np.uint64) for s in sets]), 1)
        return fingerprint.Digests(text, key, np.array([len(s) for s in sets]))

    a, b, took = fingerprint.difference(pack(own), pack(other))
    mixed = lambda s: sorted(fingerprint.mix(np.array(sorted(s), np.uint64), 1).tolist())
    for i, (x, y) in enumerate(zip(own, other)):
        assert sorted(a.key[a.text == i].tolist()) == mixed(x - y) and sorted(b.key[b.text == i].tolist()) == mixed(y - x)
    assert a.count.tolist() == [len(x - y) for x, y in zip(own, other)] and b.count.tolist() == [len(y - x) for x, y in zip(own, other)]
    assert took[0] == fingerprint.CELLS and took[-1] > fingerprint.CELLS
    want = [len(x & y) / len(x | y) if x | y else 1.0 for x, y in zip(own, other)]
    assert np.allclose(fingerprint.likeness(pack(own), pack(other)), want)


def test_recursive_patterns_differ(spark):
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    texts = [sep.join("ab"[b ^ x] for b in bits) for sep in ("", " ") for x in (0, 1)]
    got = fingerprint.versions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert len({r.fingerprint for r in got.collect()}) == 4


def test_changes_are_the_digests_of_one_side(spark, odd):
    def known(text):
        d = fingerprint.digests(*fingerprint.flat(fingerprint.pa.array([text or ""])))
        return set(d.key.view(np.int64).tolist())

    long = "\n".join(f"paragraph number {i}" for i in range(500))
    texts = [r.text for r in odd.collect()] + [long, long.replace("number 77", "no 77"), long + "\none more", ""]
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(texts, [*texts[1:], None]))] + [(None, "x", "y"), (0, "x", "x"), (0, "x", "x")]
    df = spark.createDataFrame(pairs, "doc_id long, old string, new string").selectExpr("*", "'x' as dropped", "'x' as text")
    got = sorted(((r.doc_id, r.dropped, r.added) for r in fingerprint.changes(df).collect()), key=repr)
    assert got == sorted(((i, sorted(known(a) - known(b)), sorted(known(b) - known(a))) for i, a, b in pairs), key=repr)
    assert fingerprint.changes(df.limit(0)).count() == 0
