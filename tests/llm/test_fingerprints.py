"""Sketches against brute force, and the next-document stream against a plain loop."""

import hashlib
import random

import numpy as np

from isopleth.llm import fingerprints as fp


def shingle_set(text):
    w = fp.words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def sketch(text):
    return fp.sketch(fp.WordHashes(1000).of(fp.words_of(text)))


def test_estimates():
    rng = random.Random(3)
    for n in (0, 1, 3, 8, 100, 3000, 20000):
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        other = [w if rng.random() > 0.02 else "new" for w in words]
        a, b = " ".join(words), " ".join(other)
        assert abs(fp.resemblance(sketch(a), sketch(b)) - jaccard(a, b)) < 0.12
        assert abs(fp.distinct_count(sketch(a)) - len(shingle_set(a))) <= 0.25 * len(shingle_set(a))
        half = " ".join(words[: n // 2])
        if n >= 100:
            assert fp.containment(sketch(half), sketch(a)) > 0.85
            assert abs(fp.containment(sketch(a), sketch(half)) - 0.5) < 0.15
        assert (fp.from_text(fp.to_text(sketch(a))) == sketch(a)).all()
    assert (fp.union(sketch("a b c d e f"), sketch("x y")) == np.sort(np.concatenate([sketch("a b c d e f"), sketch("x y")]))).all()


def test_sketch_is_the_lowest_distinct_hashes():
    hashes = fp.WordHashes().of([f"w{i % 40}" for i in range(3000)] + [f"v{i}" for i in range(50)])
    for k in (10, 256):
        assert (fp.sketch(hashes, k) == np.unique(fp.shingles(hashes, 5) >> np.uint64(16))[:k]).all()


def test_stream(spark):
    rng = random.Random(1)
    rows = [(i * 7 - 50, " ".join(rng.choice("aé 中 bcd") for _ in range(rng.randrange(60))), "x", 1) for i in range(300)]
    rows += [(None, "lost", "x", 1), (None, None, "x", 1), (70, None, "x", 1), (70, "twice", "x", 1), (99999, "Last One", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sentinel string, part int")
    found = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in fp.fingerprint_edits(docs).collect()}
    ordered = sorted(((i, t or "") for i, t, _, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    assert len(found) == len(rows)
    for (key, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        q = len(text) // 4
        changed = text[: len(text) - q] + after[:q]
        row = found[key, len(text), hashlib.sha256(changed.encode()).hexdigest()]
        assert abs(row.near_edited - jaccard(text, changed)) < 1e-9 and abs(row.near_next - jaccard(text, after)) < 1e-9
        assert row.fingerprint == fp.to_text(sketch(text)) and row.edited_fingerprint == fp.to_text(sketch(changed))
    assert fp.fingerprint_edits(docs.limit(0)).count() == 0
    assert fp.fingerprint_edits(docs.where("doc_id = 99999")).first().near_next == 1.0


def test_merge(spark):
    texts = [" ".join(f"w{i * 200 + j}" for j in range(300)) for i in range(4)]
    parts = spark.createDataFrame([("a" if i < 3 else None, t) for i, t in enumerate(texts)] + [("b", None)], "k string, text string").withColumn("fingerprint", fp.fingerprint())
    merged = {r.k: r.fingerprint for r in fp.merge_fingerprints(parts, "k").collect()}
    whole = np.unique(np.concatenate([sketch(t) for t in texts[:3]]))[:256]
    assert merged == {"a": fp.to_text(whole), None: fp.to_text(sketch(texts[3])), "b": ""}
