"""The join against all pairs by brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopleth.llm import ngramjoin as nj
from isopleth.llm.fingerprints import words_of
from tests.llm.test_components import plain


def brute(rows, percent=90):
    sets = {}
    for key, text in rows:
        w = words_of(text or "")
        sets[key] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    keys = sorted(k for k in sets if k is not None and sets[k])
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    up = plain(links)
    return {k: (len(s), up.get(k, k)) for k, s in sets.items()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(10**6)}"
        elif kind == 1 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, "the")
    return words


def rows_of(seed, families, copies, lengths):
    rng, rows = random.Random(seed), []
    for _ in range(families):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice(lengths))]
        for _ in range(rng.randrange(1, copies)):
            base = edited(rng, base, rng.randrange(0, 1 + len(base) // 60 + 1)) if rng.random() < 0.8 else base
            rows.append(" ".join(base).capitalize())
    rng.shuffle(rows)
    return [(3 * i + 5, t) for i, t in enumerate(rows)]


ODD = [(-3, ""), (-2, None), (1, " \n"), (2, "one"), (3, "ONE"), (4, "one two"), (None, "one two"), (None, None), (0, "z " * 5000), (7001, "z " * 4000)]


@pytest.mark.parametrize("tile", [nj.TILE, 400])
def test_join(spark, tile):
    rows = rows_of(1, 60, 8, [1, 2, 3, 5, 9, 12, 20, 25, 40, 80, 200, 600]) + ODD
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, component int, size int").repartition(3)
    expected = brute(rows)
    found = nj.near_components(docs, tile=tile).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == {k: v for k, v in expected.items() if k is not None}


def test_large_group_in_tiles(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(5)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.near_components(docs, tile=3000).collect()}
    assert found == brute(rows)


def test_no_linked_pair_lacks_a_common_key():
    rng, bands = np.random.default_rng(0), nj.Bands(90)
    for size in [*range(1, 60), 100, 333, 1000, 5000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            most = (10 * len(a)) // 100
            gone, more = rng.integers(0, most + 1), rng.integers(0, most // 2 + 1)
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 190 * both >= 90 * (len(a) + len(b)):
                assert np.intersect1d(bands.keys(a), bands.keys(b)).size


def test_edges(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (4, "A b C d")], "doc_id long, text string")
    assert sorted(map(tuple, nj.near_components(docs).collect())) == [(4, 2, 4), (5, 2, 4), (5, 2, 4)]
    assert nj.near_components(docs.limit(0)).count() == 0
    assert nj.keep_first(docs).collect()[0].doc_id == 4


def compared(spark, monkeypatch, rows, **how):
    """The components found, and how many documents of how many groups came to the tiles."""
    seen, before = [], nj.verified_links
    monkeypatch.setattr(nj, "verified_links", lambda docs, members, *rest: seen.append(members.select("id", "group").collect()) or before(docs, members, *rest))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.near_components(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}
    return found, len(seen and seen[0]), len({r.group for r in (seen and seen[0])})


def test_documents_of_common_phrases_are_not_compared(spark, monkeypatch):
    rng = random.Random(3)
    phrases = [[f"p{k}x{i}" for i in range(20)] for k in range(8)]
    texts = [" ".join([*rng.choice(phrases), *(f"own{i}x{j}" for j in range(10)), *rng.choice(phrases)]) for i in range(150)]
    rows = list(enumerate([*texts, f"{texts[7]} more"]))
    found, n, _ = compared(spark, monkeypatch, rows)
    assert found == brute(rows) and found[150][1] == 7
    assert n == 2


def test_chained_groups_are_split(spark, monkeypatch):
    rng = random.Random(4)
    lines = [[f"l{k}x{i}" for i in range(12)] for k in range(60)]
    texts = []
    for i in range(40):  # pairs of near copies, made of lines that other pairs have too
        words = [w for k in rng.sample(range(60), 8) for w in lines[k]]
        texts += [" ".join(words), " ".join([*words[:-1], f"end{i}"])]
    rows = list(enumerate(texts))
    found, n, groups = compared(spark, monkeypatch, rows, tile=2000)
    assert found == brute(rows) and found[1][1] == 0
    assert groups >= 10


def test_a_part_of_the_shingles_puts_unlike_documents_aside(spark):
    rng = random.Random(9)
    common = [f"common{i}" for i in range(60)]
    texts = [" ".join(common + [f"w{rng.randrange(10**9)}" for _ in range(340)]) for _ in range(200)]
    texts += [t + " end" for t in texts[:10]] + ["a b", "a b", "", "lone words here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    part, every = (nj.cut(nj.shared_counts(docs, 3, "doc_id", "text", share)) for share in (0.25, 1))
    able = {r.id for r in nj.able_to_link(part, 90).collect()}
    linked = {*range(10), *range(200, 210), 210, 211}
    assert linked == {r.id for r in nj.able_to_link(every, 90).collect()}
    assert linked <= able and len(able) <= len(linked) + 1
    rows = [r.where(f"kind = {nj.SHARED}").agg(F.sum("b")).first()[0] for r in (part, every)]
    assert 0 < rows[0] < 0.4 * rows[1]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.near_components(docs).collect()}
    assert all(found[i][1] == (i - 200 if 200 <= i < 210 else 210 if i == 211 else i) for i in range(len(texts)))
    assert found[0][0] == 398 and found[210][0] == 1 and found[212][0] == 0
