"""The flagship plan on a few chunks, and the default models."""

import numpy as np
from pyspark.sql import functions as F

from isopleth.functions import models
from isopleth.plans import answer, registry


def test_models():
    a, b, c, d = models.hashed_embedding(["rain over Prague", "Prague rain", "wind", ""])
    assert a @ b > 0.7 > abs(a @ c) and not d.any() and np.isclose(np.linalg.norm(a), 1)
    assert models.lexical_overlap(["rain in may", ""], ["May rain", "x"]) == [2 / 3, 0.0]


def test_a_word_is_hashed_once(monkeypatch):
    hashed, real = [], models.zlib.crc32
    monkeypatch.setattr(models.zlib, "crc32", lambda x: (hashed.append(x), real(x))[1])
    texts = ["gale " * 300 + "Frost hail\u00df 12", "", "... !", " ".join(f"sleet{i % 50}" for i in range(500))]
    got = models.hashed_embedding(texts)
    assert len(hashed) == len(set(hashed))
    plain = np.zeros_like(got)
    for row, text in enumerate(texts):
        for word in models.words(text):
            plain[row, real(word.encode()) % models.DIMENSIONS] += 1 if real(word.encode()) >> 31 else -1
    plain = np.sign(plain) * np.sqrt(np.abs(plain))
    assert got.dtype == np.float32 and np.array_equal(got, plain / np.maximum(np.linalg.norm(plain, axis=1, keepdims=True), 1e-30))


def test_plan(spark):
    rows = [(i, f"{w} statistics of station {i}", f"s{i % 5}", w, f"d{i % 2}", i == 3) for i, w in enumerate(["drought", "rain", "wind", "heat"] * 10)]
    chunks = spark.createDataFrame(rows, "id long, text string, source string, variable string, dataset string, is_summary boolean").withColumn("embedding", models.embedded(F.col("text")))
    questions = spark.createDataFrame([(1, "compare drought statistics"), (2, "wind trend"), (3, None)], "query_id long, question string")
    found = answer.search(questions, chunks, top_k=5)
    by = {}
    for r in found.orderBy("rank").collect():
        by.setdefault(r.query_id, []).append(r)
    assert [r.rank for r in by[1]] == [1, 2, 3, 4, 5] and by[1][0].variable == "drought" and by[2][0].variable == "wind"
    prompt = answer.prompts(found.where("query_id = 1"), chunks).first().prompt
    assert prompt.startswith("Question type: comparison\nTopics: drought\n<document rank=\"1\"") and prompt.endswith("Question: compare drought statistics")
    assert answer.plain_answers(found, chunks).where("query_id = 2").first().answer.count("\n") == 4
    assert 3 in {r.query_id for r in answer.weak_questions(found).collect()}
    assert found.withColumn("s", models.reranked(F.col("question"), F.col("variable"))).where("query_id = 2 and rank = 1").first().s == 0.5


def test_weak_questions_are_asked_again(spark):
    words = ["drought", "rain", "wind", "heat"]
    rows = [(i, f"{words[i % 4]} statistics of station {i}", f"s{i % 3}", words[i % 4], f"d{i % 2}", False) for i in range(24)]
    chunks = spark.createDataFrame(rows, "id long, text string, source string, variable string, dataset string, is_summary boolean").withColumn("embedding", models.embedded(F.col("text")))
    questions = spark.createDataFrame([(1, "wind statistics"), (2, "zebra"), (3, "quagga"), (4, "okapi")], "query_id long, question string")

    def generate(prompt):
        if "in one word" in prompt:
            return None if "okapi" in prompt else "Insufficient."
        return '"heat statistics station"' if "zebra" in prompt else "Quagga"

    found = answer.search_all(questions, chunks, top_k=4)
    assert {r.query_id for r in answer.weak_questions(found).collect()} == {2, 3, 4}
    asked = answer.rewritten(found, questions, chunks, generate).collect()
    assert [tuple(r) for r in asked] == [(2, "heat statistics station")]
    whole = answer.search_with_retry(questions, chunks, generate, top_k=4)
    more = {tuple(r) for r in whole.collect()} - {tuple(r) for r in found.collect()}
    assert more and {r[0] for r in more} == {2} and min(r[-1] for r in more) == 5 and len({(r[3], r[4]) for r in more}) == len(more)


def test_lists_of_a_search(spark):
    rows = [(i, f"{w} statistics of station {i}", f"s{i % 6}", w, f"d{i % 3}", i % 5 == 0) for i, w in enumerate(["drought", "rain", "wind", "heat"] * 20)]
    chunks = spark.createDataFrame(rows, "id long, text string, source string, variable string, dataset string, is_summary boolean").withColumn("embedding", models.embedded(F.col("text")))
    questions = spark.createDataFrame([(1, "drought and rain statistics"), (2, "wind statistics")], "query_id long, question string")
    variants = spark.createDataFrame([(2, 1, "heat statistics station")], "query_id long, n int, text string")
    lists = answer.ranked_lists(questions, chunks, variants)
    sizes = {(r.query_id, r.list_id): (r.n, r.top) for r in lists.groupBy("query_id", "list_id").agg(F.count("*").alias("n"), F.max("rank").alias("top")).collect()}
    assert sizes[1, 0] == (60, 60) and sizes[1, 1] == (6, 6) and sizes[2, 2] == (20, 20) and sizes[1, 100] == sizes[1, 101] == (20, 20) and len(sizes) == 7
    placed = answer.retrieve.chosen_order(lists, answer.WEIGHTS, F.col("topics") > 1).orderBy("query_id", "place").collect()
    assert [r.place for r in placed if r.query_id == 1] == list(range(1, sum(r.query_id == 1 for r in placed) + 1)) and len({r.source for r in placed if r.query_id == 2}) >= 4


def test_chunks_are_embedded_once(spark, tmp_path):
    def embed(texts):
        with (tmp_path / "texts").open("a") as out:
            out.writelines(f"{text}\n" for text in texts)
        return models.hashed_embedding(texts)

    rows = [(i, f"{w} statistics of station {i}", f"s{i % 6}", w, f"d{i % 3}", i % 5 == 0) for i, w in enumerate(["drought", "rain", "wind", "heat"] * 20)]
    chunks = spark.createDataFrame(rows, "id long, text string, source string, variable string, dataset string, is_summary boolean").withColumn("embedding", models.embedded(F.col("text"), embed))
    questions = spark.createDataFrame([(1, "drought and rain statistics"), (2, "wind statistics")], "query_id long, question string")
    assert answer.search_all(questions, chunks).count()
    seen = (tmp_path / "texts").read_text().splitlines()
    assert sorted(seen) == sorted(r[1] for r in rows)


def test_registered(spark):
    assert registry.queries()["rag_search"](spark, "/root/testdata/sf0.001").count() > 0
