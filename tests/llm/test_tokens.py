"""Token shards and packing against the tokenizers library itself."""

import io
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from isopleth.llm import packing, sstable
from isopleth.llm.tokens import WordTokens, by_size

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start long"
ROWS = [
    (5, "Hello, world!  it's 2024", 1), (3, None, 1), (9, "", 1), (3, "a b\nc\t d", 2), (None, "no id", 3), (-4, "ÉCOLE naïve Σίσυφος ΟΔΟΣ", 1),
    (11, "x" * 5000 + " y" * 4000, 0), (12, "odd space here\x1cthere", 0), (13, "é ́a 中文 字", 0), (14, "<|endoftext|> tail", 0), (15, "a<|ENDOFTEXT|> B <|startoftext|>c", 0),
]


def plain(text, end):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def test_remembered_words_equal_the_library():
    more = ["The end. (the END!). a.b.c it's don't! I\u0307 \u0130 K. \u212a x\u0301 \xe9. 1234 5a6 b7. A!! \u2026. .... \u0663\u0664 \u1e9e \x00 \u3000 \xa0y", "a \u0301b c"]
    for limit in (4, 1000):
        encoder = WordTokens(VOCABULARY, limit)
        for text in [r[1] for r in ROWS] + more + more[::-1]:
            assert np.frombuffer(encoder.encode(text or ""), "<u4").tolist() == plain(text, 0)[:-1], text
    assert len(encoder.known) <= 500
    plainly = Tokenizer.from_file(VOCABULARY)
    plainly.encode_special_tokens = True
    for text in ("a <|endoftext|> b", "A<|ENDOFTEXT|>"):
        assert np.frombuffer(WordTokens(VOCABULARY, special_as_text=True).encode(text), "<u4").tolist() == plainly.encode(text, add_special_tokens=False).ids


def test_remembered_words_equal_the_library_on_documents():
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    expected = [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder = WordTokens(VOCABULARY, 5000)
    assert [ids for some in by_size(texts, 100_000) for ids in encoder.encode_all(texts[some])] == expected


def test_token_ids(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    found = sstable.token_ids(docs, VOCABULARY).orderBy("start").collect()
    start, expected = 0, []
    for key, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = plain(text, 1)
        expected.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in found] == expected
    assert sstable.token_ids(docs.limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_lookup(wide):
    sink = io.BytesIO()
    writer = sstable.ShardWriter(sink, wide)
    rows = {k: struct.pack("<III", k % 60000, 1, 2) * 40 for k in range(-3000, 9000, 3)}
    for key, ids in rows.items():
        writer.add(sstable.key_bytes(key), ids)
    writer.add(sstable.key_bytes(8997), struct.pack("<I", 7))
    writer.close()
    reader = sstable.ShardReader(io.BytesIO(sink.getvalue()))
    assert len(reader.index) > 3 and reader.ids == 120 * len(rows) + 1
    for key in range(-3000, 8996):
        assert reader.get(sstable.key_bytes(key)) == ([rows[key]] if key in rows else [])
    assert len(reader.get(sstable.key_bytes(8997))) == 2
    with pytest.raises(ValueError):
        sstable.ShardReader(io.BytesIO(b"x" * 100))


def test_best_fit_takes_the_fullest_bin_and_closes_it_first():
    fit = packing.BestFit(10, open_bins=2)
    assert [fit.place(n) for n in (7, 6, 3, 4)] == [(0, 0), (1, 0), (0, 7), (1, 6)]
    assert [fit.place(n) for n in (8, 7, 6)] == [(2, 0), (3, 0), (4, 0)]
    assert fit.place(2) == (3, 7)  # bin 2, the fullest of three, was closed


def test_pack(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    found = packing.pack(docs, VOCABULARY, capacity=256).collect()
    places, pieces = {}, {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    for key, text, _ in ROWS:
        if key != 3:
            ids = np.array(plain(text, 0), "<u4")
            assert sorted(pieces[key]) == [(i, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for i, a in enumerate(range(0, len(ids), 256))]
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0


def test_pack_over_many_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = packing.pack(docs.repartition(211), VOCABULARY).groupBy("sequence_id").agg({"length": "sum"}).toPandas().iloc[:, 1]
    assert found.max() <= 2048 and len(found) <= 1.01 * -(-found.sum() // 2048) + 1
