import brute
import numpy as np
import pytest
from conftest_llm import rows
from pyspark.sql import functions as F

from quantloom.llm import contracts, ngram_join, runindex, sharding, substrings
from quantloom.llm._components import components


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def mixed(spark):
    """Copies, near copies, passages within and across texts, periods, and short texts."""
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    passage, base = word(70), word(300)
    out = [(i, " ".join(word(120))) for i in range(20)]
    out += [(20 + i, " ".join(word(30) + passage + word(40))) for i in range(12)]
    for i in range(25):
        copy = list(base)
        copy[int(rng.integers(0, 300))] = f"x{i}"
        out.append((40 + i, " ".join(copy)))
    out += [(70 + i, " ".join(base)) for i in range(6)]
    out += [(80, "ab" * 400), (81, "abc" * 300 + "ab" * 100), (82, "a " * 500), (83, "one two three"), (84, "ONE two  three"), (85, ""), (86, None), (87, "é" * 300), (88, " ".join(passage[:49])), (89, " ".join(passage[:50]))]
    out += [(90, " ".join(passage + word(5) + passage))]
    return spark.createDataFrame(out, "doc_id long, text string").repartition(5)


def test_words_match_brute_force(spark, sf, real, mixed):
    for df in (real, mixed):
        got = substrings.drop_repeated_words(df)
        assert rows(got.drop("kept")) == sorted(brute.substring(texts(df)), key=repr)
    assert rows(contracts.op2_substring(spark, sf)) == sorted(brute.substring(texts(real)), key=repr)


def test_bytes_match_brute_force(spark, sf, real, mixed):
    for df in (real, mixed):
        got = runindex.drop_repeated_bytes(df)
        assert rows(got.drop("kept")) == sorted(brute.repeated_bytes(texts(df)), key=repr)
        assert {r.doc_id: len(r.kept) for r in got.collect()} == {r.doc_id: r.n_bytes - r.n_removed for r in got.collect()}


def test_classes_match_brute_force(spark, sf, real, mixed):
    assert rows(contracts.op4_ngram_join(spark, sf).drop("n_links")) == sorted(brute.classes(texts(real)), key=repr)
    for n, percent in ((4, 85), (5, 80), (2, 50)):
        got = ngram_join.classes(mixed, n, percent).select("doc_id", "n_shingles", "component_id")
        assert rows(got) == sorted(brute.classes(texts(mixed), n, percent), key=repr)


def test_crowded_shingles_lose_no_link(spark, monkeypatch):
    """Chains of links through classes that the first round leaves apart."""
    monkeypatch.setattr(ngram_join, "FIRST", 10**6)
    base = [f"w{i}" for i in range(60)]
    chain = [(i, " ".join(base[i : i + 40])) for i in range(15)]
    df = spark.createDataFrame(chain, "doc_id long, text string")
    for percent in (80, 90, 95):
        assert rows(ngram_join.classes(df, 4, percent).select("doc_id", "n_shingles", "component_id")) == sorted(brute.classes(chain, 4, percent), key=repr)


def test_pairs_are_verified_once(spark, real, mixed, monkeypatch):
    """Pairs of the second round were not verified in the first."""
    seen = []
    verified = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *a: (seen.extend(map(tuple, pairs.collect())), verified(pairs, *a))[1])
    for df in (real, mixed):
        seen.clear()
        ngram_join.classes(df, 4, 85).collect()
        assert seen and len(set(seen)) == len(seen) and all(a < b for a, b in seen)


def test_suffix_filter_drops_no_link():
    rng = np.random.default_rng(4)
    rule = ngram_join.Rule(4, 70)
    for _ in range(500):
        x = set(rng.integers(0, 40, 20).tolist())
        y = set(list(x)[: rng.integers(8, len(x) + 1)]) | set(rng.integers(0, 40, rng.integers(0, 5)).tolist())
        first = min(x & y, default=None)
        if first is None:
            continue
        at = [sorted(s).index(first) for s in (x, y)]
        parts = [[np.array([sum(v > first and v % 4 == c for v in s)]) for c in range(4)] for s in (x, y)]
        sizes = [np.array([len(s)]) for s in (x, y)]
        if 100 * len(x & y) >= 70 * len(x | y):
            assert rule.suffixes(sizes[0], at[0], parts[0], sizes[1], at[1], parts[1]).all()


def test_numbers_of_links_match_brute_force(spark, mixed, monkeypatch):
    """All links count, not only those that connect components; blocks of any size give the same."""
    for n, percent in ((4, 85), (2, 50)):
        sets = {}
        for d, t in texts(mixed):
            w = brute.SPACED.findall(brute.lower(t))
            sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
        want = {a: sum(a != b and bool(x & y) and 100 * len(x & y) >= percent * len(x | y) for b, y in sets.items()) for a, x in sets.items()}
        assert max(want.values()) > 20
        for block in (512, 7):
            monkeypatch.setattr(ngram_join, "BLOCK", block)
            assert {r.doc_id: r.n_links for r in ngram_join.classes(mixed, n, percent).collect()} == want
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, "z"), (4, None)], "doc_id long, text string")
    assert rows(ngram_join.classes(twice).select("doc_id", "n_links").distinct()) == [(1, 1), (2, 1), (3, 0), (4, 0)]


def test_odd_rows(spark, odd, empty, clash):
    # Equal rows count as one, so they are taken once by the plain versions.
    once = list(dict.fromkeys(texts(odd)))
    for got, want in (
        (substrings.drop_repeated_words(odd), brute.substring(once)), (runindex.drop_repeated_bytes(odd), brute.repeated_bytes(once)),
        (ngram_join.classes(odd, 4, 85), brute.classes(once)),
    ):
        assert got.count() == 9
        width = len(want[0])
        assert {tuple(r)[:width] for r in got.collect()} == {r[:width] for r in want}
    for f in (substrings.drop_repeated_words, runindex.drop_repeated_bytes, ngram_join.classes):
        assert f(empty).count() == 0 and rows(f(clash)) == rows(f(odd))
    nulls = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "z")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.classes(nulls, 4, 85).where("n_shingles = 3").collect()} == {(None, 1), (1, 1)}
    assert ngram_join.representatives(nulls).count() == 2
    kept = ngram_join.representatives(clash)
    assert kept.columns == clash.columns and kept.count() == 7 and {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 4, 7, 8}


def test_components(spark):
    edges = [(a, a + 1) for a in range(0, 30)] + [(100, 200), (200, 150), (7, 7)] + [(500, 500 + i) for i in range(50)]
    got = {r.key: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and got[200] == got[150] == 100 and all(got[500 + i] == 500 for i in range(1, 50))


def test_run_length_index():
    """Matching statistics from the samples at run ends against sorted suffixes."""
    rng = np.random.default_rng(1)
    for trial in range(60):
        parts = [rng.integers(97, 97 + rng.integers(1, 4), n).astype(np.uint8) for n in rng.integers(1, 40, rng.integers(1, 8))]
        parts += parts[:1] * (trial % 3)
        data, off = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        index = runindex.RunLengthIndex(data, off)
        suffixes = sorted((tuple(p[j:] + 1000) + (i,), index.begin_at[i] + j) for i, p in enumerate([x.astype(int) for x in parts]) for j in range(len(p) + 1))
        want = {suffixes[0][1]: (-1, 0)}
        for (x, a), (y, b) in zip(suffixes, suffixes[1:]):
            shared = next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), 0)
            want[b] = (a, shared)
        got = {a: (b, n) for block in index.stream() for a, b, n in zip(*(x.tolist() for x in block))}
        assert got == want and len(index.place) <= index.size
        for k in (1, 3, 6):
            seen, first = {}, index.earliest(k)
            for i in range(index.size):
                end = index.mark[np.searchsorted(index.mark, i)]
                s = int(np.searchsorted(index.mark, i))
                word = data[i - s : i - s + k].tobytes() if i + k <= end else i
                assert first[i] == seen.setdefault(word, i)


def test_recursive_patterns_do_not_collide(spark):
    """A text by the rule of Thue and Morse and its complement: sums of powers modulo 2^64 cannot tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    one, two = ("".join("ab"[b ^ x] for b in bits) for x in (0, 1))
    docs = [(1, one), (2, two), (3, " ".join(one)), (4, " ".join(two)), (5, " ".join(one) + " z"), (6, "c " + " ".join(two))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(ngram_join.classes(df, 4, 85).select("doc_id", "n_shingles", "component_id")) == sorted(brute.classes(docs, 4, 85), key=repr)
    assert rows(ngram_join.classes(df.where("doc_id < 3"), 5000, 85).select("component_id").distinct()) == [(1,), (2,)]
    assert rows(substrings.drop_repeated_words(df).drop("kept")) == sorted(brute.substring(docs), key=repr)
    assert rows(runindex.drop_repeated_bytes(df).drop("kept")) == sorted(brute.repeated_bytes(docs), key=repr)


def test_sharding(spark, sf, real, odd, empty, clash):
    for limit in (5_000, 40_000, 10**9):
        got = sharding.assign(real, limit).collect()
        assert len(got) == real.count()
        by = {}
        for r in got:
            by.setdefault(r.shard_id, []).append(r.n_bytes)
        total = sum(r.n_bytes for r in got)
        for shard, sizes in by.items():
            assert sum(sizes) == next(r.shard_bytes for r in got if r.shard_id == shard) and (sum(sizes) <= limit or len(sizes) == 1)
            # Only oversized buckets were split: the shard and its sibling did not fit together.
            if shard:
                assert sum(sum(s) for k, s in by.items() if k.startswith(shard[:-1])) > limit
        ids = sorted(by)
        assert not any(b.startswith(a) and a != b for a in ids for b in ids) and (total > limit or ids == [""])
    got = sharding.assign(odd, 1_000)
    assert got.count() == 9 and got.where("n_bytes = 150000").first().local_depth > 6 and rows(got) == rows(sharding.assign(clash, 1_000))
    assert sharding.assign(empty, 10).count() == 0
    plan = contracts.op5_sharding(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_of_one_id(spark):
    df = spark.createDataFrame([(1, "x " * 60), (1, "x " * 60), (1, "y " * 60), (2, "y " * 60)], "doc_id long, text string")
    got = substrings.drop_repeated_words(df)
    assert got.where("doc_id = 2").first().n_removed == 60 and got.where("doc_id = 1").agg(F.sum("n_removed")).first()[0] == 0
