import hashlib
import re

import numpy as np
from conftest_llm import rows

from quantloom.llm import contracts, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=13, share=20):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - k + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        listed = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((doc, len(w), len(hit), len(found - {None}), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=repr)


def pick(df):
    return rows(df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))


def test_query(spark, sf, real):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute([(r.doc_id, r.text) for r in real.collect()], items)
    assert pick(contracts.op8_decontamination(spark, sf)) == want
    assert any(r[5] for r in want)
    left = {r.doc_id for r in decontaminate.clean(real, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert left == {r[0] for r in want if not r[5]}


def test_odd_rows(spark, odd, empty, clash):
    items = [(1, "again and AGAIN"), (2, None), (None, "täxt mit"), (4, ""), (10, "word " * 40), (11, "lazy dog again and again call 1 269 555 3296 or mail a b mail1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([(r.doc_id, r.text) for r in odd.collect()], items)
    assert pick(decontaminate.judge(odd, bench)) == want == pick(decontaminate.judge(clash, bench))
    assert decontaminate.judge(empty, bench).count() == 0
    assert decontaminate.judge(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    best = {r.doc_id: r for r in decontaminate.judge(odd, bench).collect()}
    assert best[0].longest_words == 15 and best[0].longest_item == "11" and best[0].longest_word == 7


def test_blocks_of_test_items(spark, sf, real, odd, monkeypatch):
    """Test sets of several blocks give the same, for repeated rows too."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = real.unionByName(odd).unionByName(odd)
    want, left = rows(decontaminate.judge(docs, bench).drop("longest_item", "longest_item_word")), rows(decontaminate.clean(docs, bench))
    monkeypatch.setattr(decontaminate, "BLOCK", 10_000)
    got = decontaminate.judge(docs, bench)
    assert rows(got.drop("longest_item", "longest_item_word", "longest_word")) == rows(spark.createDataFrame(want, decontaminate.judge(docs, bench).drop("longest_item", "longest_item_word").schema).drop("longest_word"))
    assert rows(decontaminate.clean(docs, bench)) == left


def test_longest_matches():
    """Every suffix of every item is searched: matches of any length against all pairs of places."""
    import pyarrow as pa

    from quantloom.llm._text import flat

    rng = np.random.default_rng(5)
    for _ in range(40):
        kinds = rng.integers(2, 5)
        own, items = ([[f"w{x}" for x in rng.integers(0, kinds, n)] for n in rng.integers(0, most, many)] for most, many in ((30, 6), (12, 4)))
        tests = decontaminate.Tests(list(range(4)), [" ".join(x) for x in items], 5)
        m = decontaminate.Matches(*flat(pa.array([" ".join(x) for x in own])), tests)
        for i, text in enumerate(own):
            common = lambda a, b: next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            best = max((common(text[p:], it[q:]) for it in items for p in range(len(text)) for q in range(len(it))), default=0)
            assert m.best[0][i] == best
            if best:
                item = int(tests.item[m.best[1][i]])
                q, p = m.best[1][i] - tests.first[item], m.best[2][i] - m.words.first[i]
                assert items[item][q : q + best] == text[p : p + best]


def test_suffix_array_sorts():
    rng = np.random.default_rng(0)
    for _ in range(20):
        ids = rng.integers(0, 3, 60)
        order = decontaminate.suffix_array(ids, 16)
        keys = [tuple(np.append(ids, np.zeros(20, int))[i : i + 16]) for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(60))
