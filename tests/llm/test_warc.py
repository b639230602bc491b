import brute
from conftest_llm import rows

from quantloom.llm import contracts, warc
from quantloom.llm._text import shared_dir

PICK = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_query(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = contracts.op6_warc(spark, sf)
    assert rows(got.select(*PICK)) == sorted(brute.archive(pages), key=repr) and got.where("not intact").count() == 0


def test_odd_rows(spark):
    pages = [(3, "u v", "same ünï\r\n\r\nWARC/1.0 \n"), (1, None, "same ünï\r\n\r\nWARC/1.0 \n"), (2, "x", None), (5, "x", ""), (4, "x", "a" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.round_trip(df, shared_dir(spark, "t"))
    assert rows(got.select(*PICK)) == sorted(brute.archive([(a, c) for a, _, c in pages]), key=repr)
    assert got.where("page_id = 3").first().url == "u%20v" and got.where("not intact").count() == 0
    same = spark.createDataFrame([(7, "u", "p"), (7, "u", "p"), (None, "u", "p")], "page_id long, url string, html string")
    kinds = [(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(same, shared_dir(spark, "t")).collect()]
    assert sorted(kinds, key=repr) == [(7, "response", None), (7, "revisit", 7), (None, "revisit", 7)]
    assert warc.round_trip(df.limit(0), shared_dir(spark, "t")).count() == 0
    clash = df.selectExpr("*", "'x' as rec", "'x' as payload", "'x' as value")
    assert rows(warc.round_trip(clash, shared_dir(spark, "t")).select(*PICK)) == rows(got.select(*PICK))


def test_both_versions_parse():
    for v in (1, 2):
        data = warc.arc_version_block(v, "n", "20010203040506") + b"\n" + warc.arc_record(v, "http://a/b", "20010203040506", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\n") + b"\n" + warc.arc_record(v, "http://c", "200102030405", b"", mime="no-type") + b"\n"
        got = list(warc.parse_arc(data))
        assert [g[1]["URL"] for g in got] == ["http://a/b", "http://c"] and warc.split_http(got[0][2])[1] == b"body\n\n" and len(got[0][1]) == len(warc.ARC_FIELDS[v])
    assert warc._iso("200102030405") == "2001-02-03T04:05:00Z"
    assert list(warc.parse_arc(b"http://a 0.0.0.0 2001 text/html 99\nshort")) == []
    record = warc.warc_record("response", {"A": "b"}, b"x\r\n\r\ny")
    assert list(warc.parse_warc(record + record))[1][1] == b"x\r\n\r\ny"


def test_digest_is_base32_sha1():
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
