"""The pipeline: every stage's decisions against brute force on a small table."""

import random

import corpus_pipeline
from isopleth.llm import quality
from tests.llm import test_components, test_linededup, test_ngramjoin

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {"documents": {r.doc_id: r for r in docs.collect()}}
    names = list(kept)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = corpus_pipeline.new_folder(spark, name)
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        names.append(name)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    after = kept["quality_classifier"]
    memo, field = quality.WordHashes(), quality.ChainField.prior()
    failed = {k for k, r in kept["documents"].items() if quality.judge(r.text, field, memo)[5]}
    good = [k for k, q in labels.items() if q == 1 and k not in failed]
    assert len([k for k in good if k in after]) >= 0.98 * len(good)
    assert not failed & set(kept["quality_rules"])
    assert not [k for k, q in labels.items() if q == 0 and k in after]
    expected = test_linededup.brute([(k, r.text) for k, r in after.items()])
    got = kept["line_dedup"]
    wrong = [k for k, t in expected.items() if (got[k].text if k in got else "") != t and not (k not in got and not t.strip())]
    assert len(wrong) <= 0.02 * len(expected)
    assert all(r.n_chars == len(r.text) for r in got.values())
    parts = test_ngramjoin.brute([(k, r.text) for k, r in got.items()])
    assert set(kept["near_duplicates"]) == {k for k, (_, c) in parts.items() if k == c}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == set(kept["near_duplicates"]) and max(r.offset + r.length for r in pieces) <= 2048
    assert corpus_pipeline.queries().keys() == {"pipeline"} and corpus_pipeline.oracle_sql() == {}


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def brute_kept(rows, percent=80, words=5):
    """The first document of each component of those whose sets of five-word shingles are at least 0.8 alike."""
    tokens = {k: t.lower().split() for k, t in rows}
    sets = {k: {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} for k, w in tokens.items()}
    keys = sorted(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    up = test_components.plain(links)
    return {k for k in keys if up.get(k, k) == k}, links


def test_near_duplicates_are_five_words_at_four_fifths(spark):
    rng, texts = random.Random(5), []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 60, 120, 300]))]
        texts.append(base)
        scattered = list(base)
        for at in range(len(base) // 120, len(base), 55):
            scattered[at] = f"new{rng.randrange(10**6)}"
        more = rng.randrange(len(base) // 9, len(base) // 3)
        texts += [scattered, base + [f"end{rng.randrange(10**6)}" for _ in range(more)]]
    rng.shuffle(texts)
    rows = [(7 * i + 3, " ".join(t)) for i, t in enumerate(texts)]
    expected, links = brute_kept(rows)
    at_three, _ = brute_kept(rows, 90, 3)
    assert len(links) > 40 and expected < at_three  # the fixture has near copies that three words at 0.9 lose
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == expected
