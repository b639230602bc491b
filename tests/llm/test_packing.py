import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quantloom.llm import contracts, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
T = Tokenizer.from_file(PATH)


def check(pieces, docs, size=2048):
    """Every id in exactly one piece, sequences gapless, digests right.  Returns the share of padding."""
    ids = defaultdict(list)
    for doc_id, text in docs:
        ids[doc_id].append(np.append(np.array(T.encode(text or "", add_special_tokens=False).ids, "<u4"), np.uint32(1)).astype("<u4"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert by_doc.keys() == ids.keys()
    for doc_id, copies in ids.items():
        spans = sorted((p.start, p.length) for p in by_doc[doc_id])
        assert sum(n for _, n in spans) == sum(map(len, copies))
        for p in by_doc[doc_id]:
            assert p.doc_tokens == len(copies[0]) and p.ids_crc32 == zlib.crc32(copies[0][p.start : p.start + p.length].tobytes())
        if len(copies) == 1:
            assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    pad = total = 0
    for seq in by_seq.values():
        seq.sort(key=lambda p: p.offset)
        n = sum(p.length for p in seq)
        assert seq[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(seq, seq[1:])) and 0 < n <= size
        total += n
        pad += 0 if n & (n - 1) == 0 else size - n
    return pad / max(total, 1)


def test_query(spark, sf, real):
    pieces = contracts.op10_packing(spark, sf).collect()
    assert check(pieces, [(r.doc_id, r.text) for r in real.collect()]) < 0.01


def test_odd_rows(spark, odd, empty, clash):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    for df in (odd, clash.repartition(3)):
        assert check(packing.pack(df, PATH).collect(), docs) < 0.05
    assert packing.pack(empty, PATH).count() == 0


def test_encoder_matches_tokenizers():
    import pyarrow as pa

    from quantloom.llm._text import flat

    odd = ["", " ", "  a b", " a  b \n c", "\n", "x \n", "a\t b", "<|endoftext|> hi", "it's a    b", "é à  b ", "a   b", "“a” — b　 c", "x  y", "a" * 500]
    enc = packing.encoder(PATH)
    for _ in range(2):  # the second time from memory
        for text, got in zip(odd, enc.many(*flat(pa.array(odd))), strict=True):
            assert T.encode(text, add_special_tokens=False).ids == got.tolist(), text


def test_encoder_compares_bytes(monkeypatch):
    """Parts whose hashes are equal keep their own ids, within a chunk and from memory."""
    import pyarrow as pa

    from quantloom.llm._text import flat

    texts = ["one two three", "four five two", "six", "one seven <|endoftext|> eight", "a" * 3000, "b" * 3000]
    monkeypatch.setattr(packing, "block_hash", lambda data, start, end: ((end - start) % 3).astype(np.uint64))
    monkeypatch.setattr(packing, "MEMO", 7)
    enc = packing.Encoder(PATH)
    for _ in range(3):
        assert [x.tolist() for x in enc.many(*flat(pa.array(texts)))] == [T.encode(t, add_special_tokens=False).ids for t in texts]
