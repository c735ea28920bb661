"""The source audit against plain counting with Python's integers, and against SQL."""

import re
from collections import Counter, defaultdict

import pytest

from isopleth.llm import divergence, queries
from tests.oracle import compare, connect

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, best):
    of_docs, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        words = re.findall(divergence.TERM, text.translate(LOWER))
        sources[lang].add(source)
        of_docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, own in sources.items():
        kept = [t for t, n in of_docs[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in own}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in own}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in own) + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}
        for s in own:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept)) for o in own - {s}]
            terms = [(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[: best if part == "term" else None])]
    return sorted(out)


ROWS = [
    ("en", "a", "The cat, the CAT; the-the dog\x00bird 12345 \x0012 \x0012x"), ("en", "a", "the end"), ("en", "b", "the dog's bed"), ("en", None, None), ("en", "c", ""), (None, "a", "the lone"), (None, None, "the other"),
    ("en", "a", "the end"), ("de", "a", "Stra\xdfe \xc9T\xc9 İ stra\xdfe"), ("de", "b", "stra\xdfe\xa0weg 中文"), ("fr", "x", "rien"), ("en", "b", "w" * 20000 + " the" * 5000 + " \n\t\x0b the"),
]


@pytest.mark.parametrize("least,best,part_docs,part_chars", [(1, 10, 2, 10**6), (2, 2, 16384, 40), (3, 10, 5, 10**6)])
def test_edges(spark, least, best, part_docs, part_chars, monkeypatch):
    docs = spark.createDataFrame(ROWS, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS n", "'x' AS part", "3 AS p0").repartition(2)
    monkeypatch.setattr(divergence.term_counts, "__defaults__", (1, part_docs, part_chars))
    found = divergence.divergence(docs, least, best).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, found)) == plain(ROWS, least, best)


def test_term_counts_are_exact(spark):
    docs = spark.createDataFrame(ROWS, "lang string, source string, text string")
    found = {(r.lang, r.term): (r.n_docs, sorted(map(tuple, r.sources))) for r in divergence.term_counts(docs, 1, 3).collect()}
    assert found["en", "the"] == (5, [("a", 6, 3), ("b", 5002, 2)])
    assert found["de", "stra\xdfe"] == (1, [("a", 2, 1)]) and found["de", "stra\xdfe\xa0weg"] == (1, [("b", 1, 1)])
    assert found["en", "x"] == (1, [("a", 1, 1)]) and ("en", "12") not in found


def test_empty(spark):
    assert divergence.divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_twin(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), sf, queries.op11_source_divergence, queries.OP11_SQL) > 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "source", "text")
    found = divergence.divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, found)) == plain(docs.collect(), 10, 10)
