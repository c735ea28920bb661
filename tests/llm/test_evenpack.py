"""Even packing against the tokenizers library, and differencing by its sums."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from isopleth.llm.bytetokens import ByteTokens
from isopleth.llm.evenpack import differencing, even_windows, pack_even

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)
ROWS = [
    (5, "Hello, world!  it's 2024"), (3, None), (9, ""), (3, "a b\nc\t d"), (None, "no id"), (-4, "ÉCOLE naïve Σίσυφος"), (11, "x" * 50_000 + " y" * 4000), (12, "odd　space here\x1cthere \x85 "),
    (13, "é ́a 中文 字"), (14, "<|endoftext|> tail a<|endoftext|>"), (15, "  two  " * 3000), (5, "Hello, world!  it's 2024"),
]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "a", "Bc", "\n", "\t", ".", ",", "'s", "é", "\xa0", "1", "\x85", "中", "\x1c", "ing", "​", "ⅷ", "ǆ"]), max_size=16))
def test_parts_equal_the_library(pieces):
    text = "".join(pieces)
    encoder = ByteTokens.load(VOCABULARY, 8)
    assert np.frombuffer(encoder.encode_all([text.encode(), b"a b", text.encode()])[2], "<u4").tolist() == ids_of(text)


def test_documents_equal_the_library():
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    encoder, found = ByteTokens(VOCABULARY, 5000), []
    for at in range(0, len(texts), 100):
        found += encoder.encode_all([t.encode() for t in texts[at : at + 100]])
    assert found == [np.array(x.ids, "<u4").tobytes() for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert len(encoder.known) <= 2500


def test_differencing():
    random.seed(5)
    for windows in (1, 2, 3, 16):
        sizes = [random.randint(1, 256) for _ in range(12 * windows)]
        found, sums = differencing(sizes, windows), [0] * windows
        for size, window in zip(sizes, found, strict=True):
            sums[window] += size
        assert max(sums) - min(sums) <= 4
    assert differencing([], 3) == [] and sorted(differencing([5, 5], 3)) != [0, 0]
    assert differencing([8, 7, 6, 5, 4], 2) in ([1, 0, 1, 0, 0], [0, 1, 0, 1, 1])  # differences 8-7, 6-5, then 4-1, 3-1: 16 against 14


def test_the_window_count_rises():
    found = even_windows([6, 6, 6], 10)  # two windows would do for 18 tokens, but no two of these share one
    assert sorted(found) == [0, 1, 2]
    assert set(even_windows([5, 5, 5, 5], 10)) == {0, 1}


def check(rows, found, capacity, padding):
    texts = defaultdict(list)
    for key, text in rows:
        texts[key].append(np.array(ids_of(text) + [0], "<u4"))
    parts, sequences = defaultdict(lambda: defaultdict(list)), defaultdict(list)
    for r in found:
        parts[r.doc_id][r.doc_tokens].append((r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert parts.keys() == texts.keys()
    for key, docs in texts.items():
        for total in {len(d) for d in docs}:
            same = [d for d in docs if len(d) == total]
            pieces, at = sorted(parts[key][total]), [0] * len(same)
            assert sum(n for _, n, _ in pieces) == total * len(same)
            for start, n, crc in pieces:
                assert n > 0 and any(zlib.crc32(d[start : start + n].tobytes()) == crc for d in same)
            if len(same) == 1:
                assert [s for s, _, _ in pieces] == list(np.cumsum([0] + [n for _, n, _ in pieces])[:-1])
    wasted = 0
    for pieces in sequences.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= capacity
        wasted += 0 if end & (end - 1) == 0 else capacity - end
    assert wasted <= padding * sum(r.length for r in found), wasted


def test_edges(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1L AS start", "'x' AS ids", "2 AS length")
    check(ROWS, pack_even(docs, VOCABULARY).collect(), 1024, 0)
    check(ROWS, pack_even(docs.repartition(3), VOCABULARY, capacity=64, windows=8, grain=16, second=400).collect(), 64, 0.02)
    assert pack_even(docs.limit(0), VOCABULARY).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = pack_even(docs.repartition(5), VOCABULARY, windows=16).collect()
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], found, 1024, 0.001)
