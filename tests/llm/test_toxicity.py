import zlib

import numpy as np
from conftest_llm import rows

from quantloom.llm import contracts, toxicity


def segments(scores):
    """All maximal segments by definition: repeatedly the best segment, then both sides."""
    out = []

    def split(a, b):
        best = max(((sum(scores[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None, key=lambda x: (x[0], -(x[2] - x[1])))
        if best and best[0] > 0:
            out.append(best)
            split(a, best[1])
            split(best[2], b)

    split(0, len(scores))
    return sorted((i, j) for _, i, j in out)


def test_segments_by_definition():
    rng = np.random.default_rng(0)
    for _ in range(60):
        s = rng.normal(-0.2, 1, 25)
        assert sorted((a, b) for _, a, b in toxicity.segments(s)) == segments(s.tolist())
    assert toxicity.segments(np.zeros(0)) == [] and toxicity.segments(np.array([-1.0, -2.0])) == []


def test_log_odds_by_definition():
    """Shares of toxic texts with a prior centred on the prefix's share, from the shortest prefix on."""
    parent, y, n = np.array([1, 2, -1, 1, -1]), np.array([3.0, 4, 6, 0, 0]), np.array([0.0, 1, 2, 1, 9])
    share = {i: None for i in range(5)}

    def of(i):
        return 0.2 if i < 0 else (y[i] + toxicity.PRIOR * of(parent[i])) / (y[i] + n[i] + toxicity.PRIOR)

    want = [np.log(of(i) / (1 - of(i))) - np.log(0.25) for i in share]
    assert np.allclose(toxicity.log_odds(parent, y, n, 0.2), want)


def test_score_by_definition(spark, real, sf):
    """Scores of whole texts from the model's log-odds, with plain loops."""
    import re

    model = toxicity.fit(real, contracts.training_labels(spark, sf))
    weight = dict(zip(model.key.tolist(), model.weight.tolist()))
    docs = [r for r in real.collect() if r.text and len(r.text) < 2000][:60]
    got = {r.doc_id: r for r in toxicity.score(real, model).collect()}
    for r in docs:
        words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text))]
        scores = []
        for w in words:
            h = [int(x[0]) for x in toxicity.features(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))]
            scores.append(next((weight[x] for x in h if x and x in weight), 0.0) - toxicity.DRIFT)
        normal, found = [], []
        for a, b in segments(scores) if len(scores) <= 60 else sorted((a, b) for _, a, b in toxicity.segments(np.array(scores))):
            total, positive, seen, counted = sum(scores[a:b]), 0.0, {}, 0.0
            for s, w in zip(scores[a:b], words[a:b]):
                if s > 0:
                    seen[w] = seen.get(w, 0) + 1
                    positive, counted = positive + s, counted + s / seen[w]
            chance = np.log(model.k * len(scores))
            normal.append(model.rate * total * counted / positive - chance)
            if model.rate * total - chance >= -np.log(toxicity.LEVEL):
                found.append((a, b))
        p = 1 / (1 + np.exp(-(model.bias + model.slope * np.log1p(toxicity.joined(normal)))))
        assert abs(got[r.doc_id].score - p) < 1e-6 and [(x.start, x.end) for x in got[r.doc_id].passages] == found


def test_held_out(spark):
    folder = "/root/testdata/sf0.1"
    got = contracts.op9_toxicity(spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    assert len(got) == 10_000 and got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    m = got.merge(labels, on="doc_id")
    m = m[m["held_out"]]
    toxic = m["toxic"] == 1
    assert m.loc[toxic, "predicted"].mean() > 0.9 and m.loc[~toxic, "predicted"].mean() < 0.005


def test_odd_rows(spark, odd, empty, clash, real, sf):
    model = toxicity.fit(real, contracts.training_labels(spark, sf))
    got = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
    assert got[1].score == got[2].score == got[7].score < 0.5 and got[1].passages == []
    assert rows(toxicity.score(odd, model)) == rows(toxicity.score(clash, model)) and toxicity.score(empty, model).count() == 0
    assert toxicity.accepted(clash, model).columns == clash.columns
    none = toxicity.fit(real, contracts.training_labels(spark, sf).limit(0))
    assert toxicity.score(odd, none).where("score >= 0.5").count() == 0
    nulls = spark.createDataFrame([(None, 1), (0, None), (3, 1), (3, 1)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, nulls)).count() == 9


def test_repeats_blank_out_no_passage(spark):
    """Three early single places of each toxic word leave dense passages behind them as they are."""
    bad = ["vile", "grim", "foul", "dire"]
    data, start = np.frombuffer(" ".join(bad).encode(), np.uint8), np.arange(0, 20, 5)
    key = np.sort(toxicity.features(data, start, start + 4)[0])
    model = toxicity.Model(key, np.full(4, 2.0), 1.0, 0.1, -2.0, 3.0)
    singles = [x for _ in range(3) for word in bad for x in [word, *["plain"] * 60]]
    gap, dense = ["plain"] * 150, bad * 3
    texts = [singles, singles + dense, singles + dense + gap + dense, ["vile"] * 1000, bad * 100]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    places = {i: [(p.start, p.end) for p in r.passages] for i, r in got.items()}
    n, end = len(singles), len(singles) + len(dense)
    assert places[0] == [] and places[1] == [(n, end)] and places[2] == [(n, end), (end + 150, end + 162)]
    assert got[0].score < 0.5 < got[1].score < got[2].score and got[1].predicted == got[2].predicted == 1
    # Repeats of one word add little to the score, but the place is found; a long passage is not worse than a short one.
    assert places[3] == [(0, 1000)] and got[3].score < got[4].score and places[4] == [(0, 400)] and got[4].predicted == 1
    assert [r.doc_id for r in toxicity.accepted(df, model).select("doc_id").collect() if r.doc_id in (1, 2, 4)] == []
