"""Legacy archives: ARC files of either version are parsed by their header lines and declared lengths
and rewritten as WARC, with synthesised identifiers, timestamps, types and digests."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The field names of ARC header lines, by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Bytes of payload that one archive file holds, about; files are compressed and read whole.
FILE_BYTES = 16 << 20

_LAST = (1 << 63) - 1


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fields = ["filedesc://" + name, "0.0.0.0", date, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else [])
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body


def arc_record(version: int, url: str, date: str, content: bytes, name: str = "-", ip: str = "0.0.0.0", mime: str = "text/html") -> bytes:
    url = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    fields = [url, ip, date, mime] + (["200", digest(content), "-", "0", name] if version == 2 else [])
    return " ".join([*fields, str(len(content))]).encode() + b"\n" + content


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, content) of each record of an ARC file, without its version block.

    The version block names the version; without one, a line's number of fields tells it.  A line that
    is no header, or a length beyond the file, ends the file.
    """
    at, version = 0, None
    while at < len(data):
        if data[at] in (10, 13):
            at += 1
            continue
        to = data.find(b"\n", at)
        if to < 0:
            return
        line = data[at:to].decode("utf-8", "replace").strip().split(" ")
        names = ARC_FIELDS.get(version) or next((f for f in ARC_FIELDS.values() if len(f) == len(line)), None)
        if line[0].startswith("filedesc:"):
            names = next((f for f in ARC_FIELDS.values() if len(f) == len(line)), names)
        if names is None or len(line) != len(names) or not line[-1].isdigit() or to + 1 + int(line[-1]) > len(data):
            return
        content = data[to + 1 : to + 1 + int(line[-1])]
        if line[0].startswith("filedesc:"):
            version = int(content[:1]) if content[:1] in (b"1", b"2") else None
        else:
            yield at, dict(zip(names, line, strict=True)), content
        at = to + 1 + len(content)


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and payload."""
    at = content.find(b"\r\n\r\n") + 4 if content.startswith(b"HTTP/") else 0
    return (content[:at], content[at:]) if at >= 4 else (b"", content)


def warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind} | fields | {"Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record, by its declared length."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        to = data.find(b"\r\n\r\n", at)
        if to < 0:
            return
        lines = data[at:to].decode("utf-8", "replace").split("\r\n")[1:]
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        n = int(fields.get("Content-Length", 0))
        yield fields, data[to + 4 : to + 4 + n]
        at = to + 4 + n


def _header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace") if m else None


def _write(df: DataFrame, path: str, records: int = 0) -> None:
    """Rows of a binary column as bytes end to end, compressed by file: each value lacks the line feed that the
    writer adds.  ``records``: rows of a file at most."""
    df.select(F.col("value").cast("string").alias("value")).write.mode("error").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def write_arc(pages: DataFrame, path: str, version: int, date: str = "20000101000000", records: int = 1000) -> None:
    """One ARC record for each page (page_id, url, html): an HTTP response whose payload is the html in UTF-8.
    Every file of at most ``records`` rows begins with its version block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, row = f"part-{TaskContext.get().partitionId()}.arc", 0
        for batch in batches:
            out = []
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if row % records == 0:
                    out.append(arc_version_block(version, name, date))
                    row += 1
                payload = (html or "").encode()
                head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n" + ("" if page is None else f"X-Page-Id: {page}\r\n") + "\r\n"
                out.append(arc_record(version, url or "", date, head.encode() + payload, name))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    _write(pages.select("page_id", "url", "html").mapInArrow(run, "value binary"), path, records)


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(list(paths)).select("path", "content")


def _content(value: pa.Scalar) -> bytes:
    raw = value.as_py()
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def _parsed(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes, bytes, int | None]]:
    """(offset, fields, HTTP head, payload, page_id) of each ARC record."""
    for at, fields, body in parse_arc(content):
        head, payload = split_http(body)
        page = _header(head, "X-Page-Id")
        yield at, fields, head, payload, int(page) if page else None


def index_arc(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of ARC files without their contents: path, at (offset), page_id, url, payload_bytes, payload_digest."""
    names = ["path", "at", "page_id", "url", "payload_bytes", "payload_digest"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = [(path.as_py(), at, page, f["URL"], len(payload), digest(payload)) for at, f, _, payload, page in _parsed(_content(content))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return _files(spark, *paths).mapInArrow(run, "path string, at long, page_id long, url string, payload_bytes long, payload_digest string")


def record_id(path: str, at: int) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{path}#{at}"))


def _iso(date: str) -> str:
    """WARC timestamp of a 12- or 14-digit ARC date."""
    d = re.sub(r"\D", "", date).ljust(14, "0")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def arc_to_warc(spark: SparkSession, arcs: list[str], path: str, least: int = 0, records: int = 1000) -> None:
    """Convert ARC files to WARC.  Of records with equal payloads of ``least`` bytes at least, the one of the
    smallest page_id (null last, then by place) is a response and the others revisit it.

    Only offsets and digests are shuffled to find the revisits; each file then meets the list of its own.
    """
    index = index_arc(spark, *arcs).where(F.col("payload_bytes") >= least).select("path", "at", F.coalesce("page_id", F.lit(_LAST)).alias("page"), "payload_digest")
    first = index.groupBy("payload_digest").agg(F.min(F.struct("page", "path", "at")).alias("first"))
    refs = index.join(first, "payload_digest").where("path != first.path or at != first.at")
    refs = refs.groupBy("path").agg(F.collect_list(F.struct("at", F.col("first.path").alias("ref"), F.col("first.at").alias("ref_at"), F.col("first.page").alias("page"))).alias("refs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content, listed in zip(*batch.columns, strict=True):
                ref_of = {r["at"]: r for r in listed.as_py() or ()}
                out, size = [], 0
                for at, f, head, payload, page in _parsed(_content(content)):
                    ref = ref_of.get(at)
                    block = head if ref else head + payload
                    fields = {
                        "WARC-Record-ID": f"<urn:uuid:{record_id(file.as_py(), at)}>", "WARC-Date": _iso(f["Archive-date"]), "WARC-Target-URI": f["URL"], "WARC-IP-Address": f["IP-address"],
                        "WARC-Payload-Digest": "sha1:" + digest(payload), "WARC-Block-Digest": "sha1:" + digest(block), "X-Payload-Length": str(len(payload)),
                    }
                    if page is not None:
                        fields["X-Page-Id"] = str(page)
                    if ref:
                        fields |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<urn:uuid:{record_id(ref['ref'], ref['ref_at'])}>"}
                        if ref["page"] != _LAST:
                            fields["X-Refers-To-Page"] = str(ref["page"])
                    http = head != b""
                    fields["Content-Type"] = "application/http; msgtype=response" if http else f["Content-type"]
                    out.append(warc_record("revisit" if ref else "response" if http else "resource", fields, block)[:-1])
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    joined = _files(spark, *arcs).join(refs, "path", "left").select("path", "content", "refs")
    _write(joined.mapInArrow(run, "value binary"), path, records)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: page_id, payload_bytes, payload_digest (recomputed where the payload is stored),
    record_type, refers_to (a page_id), record_id, url, warc_date, intact (stored digests agree)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "warc_date", "intact"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows: list[list] = [[] for _ in names]
                for f, block in parse_warc(_content(content)):
                    kind, told = f["WARC-Type"], f.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    payload = split_http(block)[1]
                    stored = kind != "revisit"
                    n, d = (len(payload), digest(payload)) if stored else (int(f.get("X-Payload-Length", 0)), told)
                    page, ref = f.get("X-Page-Id"), f.get("X-Refers-To-Page")
                    ok = d == told and f.get("WARC-Block-Digest", "") == "sha1:" + digest(block)
                    row = (int(page) if page else None, n, d, kind, int(ref) if ref else None, f.get("WARC-Record-ID", "")[10:-1], f.get("WARC-Target-URI"), f.get("WARC-Date"), ok)
                    for column, v in zip(rows, row, strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, warc_date string, intact boolean"
    return _files(spark, path).mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Pages to ARC files of both versions, these to WARC, and the WARC files read back.

    A null html is an empty payload, a null url becomes ``-``, a null page_id stays null; repeated rows
    are records each, of which the later ones revisit the first; an empty table gives no rows.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    size, n = pages.agg(F.sum(F.octet_length("html")), F.count(F.lit(1))).first()
    records = min(max(2, n * FILE_BYTES // max(size or 0, 1)), 100_000)
    for v in ARC_FIELDS:
        write_arc(pages.where(F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(2)) == v - 1), f"{folder}/arc-v{v}", v, records=records)
    arc_to_warc(spark, [f"{folder}/arc-v{v}" for v in ARC_FIELDS], f"{folder}/warc", records=records)
    return read_warc(spark, f"{folder}/warc")
