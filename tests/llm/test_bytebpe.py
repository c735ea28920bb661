"""Byte-level BPE against the tiktoken library."""

import hashlib
import random
import time

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from isopleth.llm import bytebpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [0, 9, 10, 11, 13, 0x1C, 0x1F, 32, 0x85, 0xA0, 0x2003, 0x2028, 0x3000, 0x301, 0xE9, 0x130, 0x4E2D, 0x6587, 0x663, 0x1F600, 0x1D400, 65, 98, 39, 115, 33]
TEXTS = ["", None, " ", "Hello  world's\n\n it's  2024!! ", "a", "é", "z" * 3000 + " " * 700 + "\n", "naïve \U0001f600 中文字符测试" * 30, "x" * 300 + "yz" * 200, " \t\n x"]


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})


def test_long_and_multi_byte_words(spark):
    encoder, rng = library(), random.Random(2)
    words = ["a", "zz", "banana" * 50, "".join(rng.choice("abcdeinrst") for _ in range(2000)), "中文" * 200, "aaa" * 5 + "b" + "a" * 7, " the" * 90, "\U0001f600" * 80, "é" * 257, "x" * 20000]
    words += ["".join(rng.choice("ab ") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    ranks = bytebpe.read_ranks(RANKS)
    marks = bytebpe.marks_of(ranks)
    assert sorted(marks, key=marks.get) == sorted(ranks, key=ranks.get)
    singles, back = {b: marks[bytes([b])] for b in range(256)}, {m: ranks[piece] for piece, m in marks.items()}
    rows = spark.createDataFrame([(w, w.encode().decode("latin-1").translate(singles)) for w in words], "word string, raw string")
    literal = bytebpe.rank_literal(ranks)
    for r in rows.select("word", bytebpe.fold_merges(F.col("raw"), literal).alias("pieces"), bytebpe.fold_long(F.col("raw"), literal).alias("long")).where("length(raw) < 1000 or word like 'xx%'").collect():
        whole = [ranks[r.word.encode()]] if r.word.encode() in ranks else None
        assert [back[m] for m in r.pieces] == [back[m] for m in r.long] == (whole or encoder._core_bpe.encode_single_piece(r.word.encode()))


def test_very_long_words(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(50_000)), "x" * 50_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(20_000)), "ababa" * 4000 + "b", "中文字" * 5000, "\u00e9" * 9000]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    encoder, began = library(), time.time()
    found = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bytebpe.digest_bpe(docs, RANKS, public_tokenizers.PATTERN).collect()}
    took = time.time() - began
    for i, w in enumerate(words):
        ids = encoder.encode_ordinary(w)
        assert found[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), i
    assert took < 120


def test_digest(spark):
    rng = random.Random(4)
    texts = TEXTS + ["".join(chr(rng.choice(ODD)) for _ in range(60)) for _ in range(200)] + ["<|endoftext|> x"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, 1) for i, t in enumerate(texts + TEXTS)], "doc_id long, text string, ids int")
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.digest_bpe(docs, RANKS, public_tokenizers.PATTERN).collect()}
    encoder, expected = library(), set()
    for i, text in enumerate(texts + TEXTS):
        ids = encoder.encode_ordinary(text or "")
        expected.add((i if i != 3 else None, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == expected
    assert bytebpe.digest_bpe(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encoder = library()
    found = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bytebpe.digest_bpe(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for r in docs.collect():
        ids = encoder.encode_ordinary(r.text or "")
        assert found[r.doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_parts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    finish = lambda key, total, ids, decoded: (key, total)

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64())])
    runs = [sorted(tuple(r) for r in bytebpe.encode(docs, RANKS, public_tokenizers.PATTERN, finish, "doc_id long, n long", schema, *sizes).collect()) for sizes in ((3, 10**6, 10**6), (10**6, 5000, 10**6), (10**6, 10**9, 300), ())]
    assert runs[0] == runs[1] == runs[2] == runs[3] and len(runs[0]) == docs.count()
