"""Line labelling and co-training: brute force for decoding and counts, held-out accuracy for the models."""

import itertools
import re

import numpy as np
import pytest

from isopleth.llm import cotrain, quality
from isopleth.llm.fingerprints import WordHashes

SF = "/root/testdata/sf0.1"


def test_viterbi_and_gradient():
    rng = np.random.default_rng(0)
    field = quality.ChainField(rng.normal(size=(2, len(quality.FEATURES))), rng.normal(size=(2, 2)))
    for n in (1, 2, 6):
        x = rng.normal(size=(n, len(quality.FEATURES)))
        value = lambda s: sum(field.weights[a] @ v for a, v in zip(s, x)) + sum(field.moves[a, b] for a, b in zip(s, s[1:]))  # noqa: E731, B023
        assert tuple(field.decode(x)) == max(itertools.product((0, 1), repeat=n), key=value)
    chains = [rng.normal(size=(n, len(quality.FEATURES))) for n in (1, 4, 9) for _ in range(30)]
    states = [field.decode(c) for c in chains]
    again = quality.ChainField().fit(chains, states)
    assert np.mean(np.concatenate([again.decode(c) == s for c, s in zip(chains, states)])) > 0.97


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


TEXTS = ["", None, " \n\t ", "a b c d e a b c d e", "a\na\n\n\na\r", "x " * 50, "A|B # é中 \U0001f600 one\x1ctwo three", "The cat sat. " * 3 + "\n" + "Dogs run far away from the house on the hill today.\n" * 2, "z" * 100000, "\n"]


def test_counts():
    memo = WordHashes()
    for text in TEXTS:
        text = text or ""
        found = quality.judge(text, quality.ChainField.prior(), memo)
        assert found[:5] == plain_counts(text), text[:50]
        assert found[5] == (found[0] < 10 or 100 * found[4] > 20 * found[0])


def test_rules(spark):
    docs = spark.createDataFrame([(i if i else None, t, 7) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    field = quality.fit_field(docs, labels)
    found = quality.apply_rules(docs, field).collect()
    assert len(found) == len(TEXTS) * 2 and [r.doc_id for r in found].count(None) == 1
    assert sorted(quality.keep_good(docs, field).toPandas().columns) == ["doc_id", "kept", "text"]
    assert quality.keep_good(docs, field).count() == sum(r.kept for r in found)
    assert quality.apply_rules(docs.limit(0), field).count() == 0


def held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0 and quality is not null")


def test_rules_on_held_out_labels(spark):
    docs, train, test = held_out(spark)
    found = quality.apply_rules(docs, quality.fit_field(docs, train)).join(test, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == bool(r.quality) for r in found]) > 0.98
    assert np.mean([r.kept for r in found if r.quality]) > 0.99


def test_co_training_on_held_out_labels(spark):
    docs, train, test = held_out(spark)
    model = cotrain.fit(docs, train)
    assert min(model.exchanged) >= 0 and sum(model.exchanged) > 0 and model.rounds >= 1
    found = cotrain.score(docs, model).join(test, "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality) for r in found]) > 0.97
    assert np.mean([r.kept for r in found if r.quality]) > 0.98
    share = np.mean([r.quality for r in found])
    assert abs(np.mean([r.score for r in found]) - share) < 0.05  # calibrated


def test_co_training_against_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    memo, rows = WordHashes(), {r.doc_id: r for r in docs.collect()}
    views = {k: (cotrain.content_view(r.text or "", memo).astype(float), cotrain.metadata_view(r.lang, r.source, r.n_chars).astype(float)) for k, r in rows.items()}
    first = sorted((str((k, float(q))), k) for k, q in known.items() if k in rows)
    inputs = [(views[k], float(known[k])) for _, k in first]
    free = [v for k, v in views.items() if k not in known]

    def pool(weights, sure):
        out = []
        for own, other in ((0, 1), (1, 0)):
            for label in (0.0, 1.0):
                slope, curve, n = np.zeros(len(weights[own])), np.zeros((len(weights[own]),) * 2), 0.0
                for v in free:
                    p = 1 / (1 + np.exp(-np.clip(v[other] @ weights[other], -30, 30)))
                    if (p >= sure) if label else (p <= 1 - sure):
                        q = 1 / (1 + np.exp(-np.clip(v[own] @ weights[own], -30, 30)))
                        slope, curve, n = slope + v[own] * (label - q), curve + max(q * (1 - q), 1e-6) * np.outer(v[own], v[own]), n + 1
                out.append((slope, curve, n))
        return out

    model = cotrain.co_train(np.array([v[0] for v, _ in inputs]), np.array([v[1] for v, _ in inputs]), np.array([q for _, q in inputs]), pool)
    assert sum(model.exchanged) > 0
    for r in cotrain.fit_and_score(docs, labels).collect():
        expected = model.score(views[r.doc_id][0][None], views[r.doc_id][1][None])[0]
        assert (r.content_score, r.metadata_score, r.score) == pytest.approx(tuple(expected), abs=1e-6)


def test_co_training_edges(spark):
    docs = spark.createDataFrame([(i if i else None, t, None, 5) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, lang string, score int")
    none = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")
    assert cotrain.fit(docs, none) is None
    assert {r.kept for r in cotrain.score(docs, None).collect()} == {True}
    both = spark.createDataFrame([(i, i % 2) for i in range(15)], "doc_id long, quality int")
    model = cotrain.fit(docs, both)
    found = cotrain.score(docs, model).collect()
    assert len(found) == 2 * len(TEXTS) and all(0 <= r.score <= 1 for r in found)
    assert cotrain.keep_good(docs, model).count() == sum(r.kept for r in found)
    assert cotrain.score(docs.limit(0), model).count() == 0


def test_logistic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x @ [1, -2, 0.5])))).astype(float)
    assert cotrain.logistic(x, y) == pytest.approx([1, -2, 0.5], abs=0.2)


def test_co_training_joins_labels_once(spark, monkeypatch, capsys):
    seen, pool = [], cotrain._pool
    monkeypatch.setattr(cotrain, "_pool", lambda rows: (seen.append(rows), pool(rows))[1])
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "#### ####", "en", "s", 15) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    assert cotrain.fit(docs, labels) is not None
    seen[0].explain()
    assert "Join" not in capsys.readouterr().out and sorted(r.doc_id for r in seen[0].collect()) == list(range(20, 40))
