"""Context mixing: base scores against a plain loop, a proper distribution, and better held-out scores than the base."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from isopleth.llm import mixing
from isopleth.llm.fingerprints import WordHashes, words_of


def plain(rows):
    held = [k is None or zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]
    counts = Counter()
    for (_, text), out in zip(rows, held):
        if not out:
            counts.update(words_of(text or "") + ["\n"])
    total, types = sum(counts.values()), len(counts)
    found = []
    for (key, text), out in zip(rows, held):
        tokens = words_of(text or "") + ["\n"]
        base = sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in tokens)
        found.append((key, out, len(tokens), sum(counts[t] > 0 for t in tokens), total, base))
    return found


ROWS = [(i, f"the quick w{i % 13} Fox\x1cjumps w{i % 5} over é {i}") for i in range(80)] + [(90, None), (91, ""), (None, "the quick new"), (4, "the the\tthe"), (92, "x" * 50000), (-7, " \n ")]


@pytest.mark.parametrize("vocabulary", [5, 1000])
def test_base(spark, vocabulary):
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in ROWS], "doc_id long, text string, word int, c int").repartition(3)
    found = mixing.score(docs, vocabulary).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    rows = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=key)
    for a, b in zip(rows, sorted(plain(ROWS), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6)
    assert all(r.score < 0 for r in found)


def test_empty(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert mixing.score(docs.limit(0)).count() == 0
    (only,) = mixing.score(docs.where("doc_id is null")).collect()
    assert only.held_out and only.train_tokens == 0 and only.n_known == 0 and only.score < 0


def test_codes_and_probabilities():
    starts, lengths, nodes, bits = mixing.huffman([50, 20, 10, 5, 5, 1])
    codes = ["".join(map(str, bits[s : s + n])) for s, n in zip(starts, lengths)]
    assert sum(2.0**-n for n in lengths) == 1 and len(set(codes)) == 6 and lengths[0] == 1
    assert not any(a != b and b.startswith(a) for a, b in itertools.product(codes, codes))
    code = mixing.Code(["a", "b"], [5, 3], 4, 2, [1] * 257)
    mixer, memo = mixing.Mixer(), WordHashes()
    rng = np.random.default_rng(0)
    for _ in range(30):
        texts = [mixing.Piece(i, ["a", "b"] * int(rng.integers(1, 9)) + ["zq"], [], True) for i in range(50)]
        slots, bits, _, escaped, _, _ = mixing.decisions(code, texts, memo)
        mixer.learn_all(slots, bits, 1)
        mixer.learn_all(*code.spelled(escaped)[:0:-1], 0)
    mixer.prepare()

    def log(words):
        slots, bits, _, escaped, _, _ = mixing.decisions(code, [mixing.Piece(0, words, [], True)], memo)
        assert escaped == [w for w in words if w not in "ab"]
        return mixer.log2(slots, bits, 1).sum() - log_end

    log_end = 0
    after = {w: log(["a", "b", *w]) for w in ("a", "b", "z", "")}  # the end comes after each but the last
    slots, bits = mixing.decisions(code, [mixing.Piece(0, ["a", "b", "a"], [], True)], memo)[:2]
    assert mixer.log2(slots, bits, 1) == pytest.approx(np.log2(1 - 2.0 ** mixer.log2(slots, 1 - bits, 1)), abs=0.1)
    assert after["a"] > after["b"]  # contexts count
    lengths, bits, slots = code.spelled(["zq", "é", ""])
    values = np.bincount(np.arange(3).repeat(lengths), mixer.log2(slots, bits, 0))
    assert lengths.min() >= 8 and values[0] > -3 > values[1] and (2.0**values).sum() < 1


def plain_mixer(batches, asked):
    """Learns batches of (slots, bits) and gives log2 of asked decisions, one decision at a time."""
    counts = [{}, {}, {}]
    weights = [[0.3, 0.4, 0.4, 0.0] for _ in range(mixing.GATES)]
    seen, half = {}, mixing.STEPS // 2
    at = lambda k, slot: counts[k].get(slot, (0, 0))
    known = lambda pair: (sum(pair) > 0) + (sum(pair) > 4) + (sum(pair) > 40)

    def mixed(slots):
        pairs = [at(k, slot) for k, slot in enumerate(slots)]
        x = [math.log((b + 0.4) / (a + 0.4)) for a, b in pairs] + [1.0]
        gate = 16 + 4 * known(pairs[2]) + known(pairs[1])
        z = max(-12.0, min(12.0, sum(w * v for w, v in zip(weights[gate], x))))
        return x, gate, z, gate * mixing.STEPS + max(-half, min(half, round(2 * z))) + half

    steep = {}
    for number, batch in enumerate(batches):
        slope, curve = {}, {}
        found = [(mixed(slots), bit) for slots, bit in batch]
        for (x, gate, z, step), bit in found:
            p = 1 / (1 + math.exp(-z))
            seen[step] = (seen.get(step, (0, 0))[0] + (not bit), seen.get(step, (0, 0))[1] + bit)
            for i in range(4):
                slope[gate, i] = slope.get((gate, i), 0.0) + (bit - p) * x[i]
                curve[gate, i] = curve.get((gate, i), 0.0) + p * (1 - p) * x[i] ** 2
        if number % 8 == 0:
            steep = curve
        for (gate, i), value in slope.items():
            weights[gate][i] += 0.3 * value / (steep.get((gate, i), 0.0) + 20)
        for slots, bit in batch:
            for k, slot in enumerate(slots):
                a, b = at(k, slot)
                counts[k][slot] = (a + (not bit), b + bit)
    out = []
    for slots, bit in asked:
        _, gate, z, step = mixed(slots)
        zeros, ones = seen.get(step, (0, 0))
        refined = (ones + 4 / (1 + math.exp(-(step % mixing.STEPS - half) / 2))) / (zeros + ones + 4)
        p = 0.5 / (1 + math.exp(-z)) + 0.5 * refined
        out.append(math.log2(p if bit else 1 - p))
    return out


def test_mixer_against_a_plain_loop(monkeypatch):
    monkeypatch.setattr(mixing, "BATCH", 50)
    rng = np.random.default_rng(3)
    slots = [rng.integers(0, n, 1000).astype(np.int32) for n in (4, 12, 40)]
    bits = (rng.random(1000) < 0.2 + 0.6 * (slots[1] % 2)).astype(np.uint8)
    mixer = mixing.Mixer()
    mixer.learn_all(slots, bits, 1)
    rows = [(tuple(int(s[i]) for s in slots), int(bits[i])) for i in range(1000)]
    expected = plain_mixer([rows[at : at + 50] for at in range(0, 1000, 50)], rows)
    assert mixer.prepare().log2(slots, bits, 1) == pytest.approx(expected, abs=2e-3)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 9000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = ({r.doc_id: (r.score, r.bits) for r in mixing.score(docs.repartition(n)).collect()} for n in (1, 16))
    assert one.keys() == many.keys() and all(many[k] == pytest.approx(one[k], rel=1e-9) for k in one)


def test_long_texts_are_cut_without_a_trace():
    code, memo = mixing.Code(["a", "b"], [5, 3], 4, 2, [1] * 257), WordHashes()
    words = ["a", "b", "zq", "a", "a", "b", "q"]
    whole = mixing.decisions(code, [mixing.Piece(0, words, [], True)], memo)
    for most in (1, 2, 3, 7):
        parts = [mixing.decisions(code, pieces, memo) for pieces in mixing.runs([words], most)]
        assert [np.concatenate([p[0][k] for p in parts]).tolist() for k in range(3)] == [s.tolist() for s in whole[0]]
        assert sum((p[3] for p in parts), []) == whole[3] and np.concatenate([p[4] for p in parts]).tolist() == whole[4].tolist()


def test_held_out_documents_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = [r for r in mixing.score(docs).collect() if r.held_out and r.n_tokens > 20]
    assert len(found) > 50
    assert sum(r.score for r in found) > sum(r.base_score for r in found)
    assert np.mean([r.score > r.base_score for r in found]) > 0.7
    assert 1 < np.mean([r.bits_per_byte for r in found]) < 3.5
