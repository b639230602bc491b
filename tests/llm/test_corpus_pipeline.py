import brute
import corpus_pipeline
import pytest
from test_decontaminate import brute as contaminated
from test_packing import check

from quantloom.llm import contracts, pii, toxicity


def test_stages_against_plain_versions(spark, sf, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, contracts.training_labels(spark, sf))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, docs, sf)
        if name != "packing":
            assert df.columns == docs.columns
        df.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if name == "toxicity":
            left = {k: v for k, v in left.items() if k not in bad}
        elif name == "ngram_join":
            left = {d: left[d] for d, _, c in brute.classes(list(left.items()), 5, 80) if c == d}
        elif name == "decontamination":
            left = {r[0]: left[r[0]] for r in contaminated(list(left.items()), items) if not r[5]}
        elif name == "pii":
            left = {k: pii.mask(v) for k, v in left.items()}
        if name == "packing":
            assert check(docs.collect(), list(left.items())) < 0.02
        else:
            assert {r.doc_id: r.text for r in docs.collect()} == left
    assert 0 < len(left) < 200


def test_run_and_odd_tables(spark, sf, odd, tmp_path):
    assert corpus_pipeline.run(spark, sf).count() > 0
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, sf)
        assert (rows.count() > 0) == (rows.where("doc_id is not null").count() > 0)


@pytest.mark.parametrize("name", ["op2_substring", "op4_ngram_join", "op5_sharding", "op6_warc", "op8_decontamination"])
def test_oracles(spark, sf, name):
    from pathlib import Path

    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    want, got = con.sql(contracts.ORACLE[name]), contracts.QUERIES[name](spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
