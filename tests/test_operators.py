"""Operators against plain loops, and streams against batches."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopleth.functions import catalog, texts
from isopleth.operators import collection, relate, retrieve, summarize
from isopleth.streaming import events


def test_knn_blocks_and_zero_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist() if i % 17 else [0.0] * 6, i % 3) for i in range(120)] + [(200, None, 1)]
    points = spark.createDataFrame(rows, "id long, embedding array<float>, label int")
    queries = points.where("id < 10").withColumnRenamed("id", "query_id")
    whole = {tuple(r) for r in retrieve.knn(queries, points, 5).collect()}
    monkeypatch.setattr(retrieve, "BLOCK", 3)
    assert {tuple(r) for r in retrieve.knn(queries, points, 5).collect()} == whole
    vectors = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if v}
    for q in range(10):
        unit = lambda v: v / (np.linalg.norm(v) or 1)
        best = sorted(((-round(float(unit(vectors[q]) @ unit(v)), 6) + 0.0, i) for i, v in vectors.items()))[:5]
        assert sorted((r[3], r[1]) for r in whole if r[0] == q) == [(n, i) for n, (_, i) in enumerate(best, 1)]
    assert retrieve.knn(queries.limit(0), points, 5).count() == 0


def test_mmr(spark):
    rng = random.Random(2)
    rows = [(q, i, round(rng.random(), 2), f"s{rng.randrange(3)}", f"d{rng.randrange(3)}", f"v{rng.randrange(2)}") for q in range(6) for i in range(rng.choice([3, 15, 40]))]
    hits = spark.createDataFrame(rows, "query_id long, id long, score double, source string, dataset string, variable string")
    found = {}
    for r in retrieve.mmr(hits, 10).collect():
        found.setdefault(r.query_id, {})[r.mmr_rank] = r.id
    for q in range(6):
        left = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        chosen = left[:] if len(left) <= 10 else []
        like = lambda a, b: 0.5 * (a[3] == b[3]) + 0.3 * (a[4] == b[4]) + 0.2 * (a[5] == b[5])
        while len(chosen) < 10 and len(left) > 10 - len(chosen) and len(chosen) < 10:
            gains = [0.55 * r[2] - 0.45 * max([0.0, *(like(r, c) for c in chosen)]) for r in left]
            best = max(range(len(left)), key=lambda i: (round(gains[i], 9), -i))
            chosen.append(left.pop(best))
        assert [found[q][n] for n in sorted(found[q])][: len(chosen)] == [r[1] for r in chosen][: len(found[q])]


def test_quota_equals_the_greedy_scan(spark):
    rng = random.Random(3)
    rows = [(q, i, rng.randrange(20) / 20, f"s{rng.randrange(4)}", f"v{rng.randrange(3)}", rng.random() < 0.2) for q in range(30) for i in range(25)]
    hits = spark.createDataFrame(rows, "query_id long, id long, score double, source string, variable string, is_summary boolean")
    found = {(r.query_id, r.id) for r in retrieve.diversity_quota(hits).collect()}
    expected = set()
    for q in range(30):
        sources, pairs = {}, {}
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])):
            if sources.get(r[3], 0) < 3 and (r[5] or pairs.get(r[3:5], 0) < 2):
                sources[r[3]] = sources.get(r[3], 0) + 1
                pairs[r[3:5]] = pairs.get(r[3:5], 0) + (not r[5])
                expected.add((q, r[1]))
    assert found == expected


def test_uuid5(spark):
    keys = ["", "a", "http://x.org/é?q=1", "chunk_17"]
    found = spark.createDataFrame([(k,) for k in keys], "k string").select("k", collection.uuid5(F.col("k")).alias("u")).collect()
    assert {r.k: r.u for r in found} == {k: str(uuid.uuid5(uuid.NAMESPACE_URL, k)) for k in keys}


def test_stats_skip_what_is_not_finite(spark):
    rows = [("a", v) for v in (1.0, 2.0, 4.0, float("nan"), float("inf"), None)] + [("b", float("nan")), ("c", 7.0)]
    found = {r.k: r for r in summarize.chunk_stats8(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert set(found) == {"a", "c"} and found["a"].n_cells == 3 and found["c"].range == 0
    assert found["a"].p10 == pytest.approx(np.percentile([1, 2, 4], 10)) and found["a"].std == pytest.approx(np.std([1, 2, 4]))


def test_collection(spark, tmp_path):
    table = collection.Collection(spark, str(tmp_path / "c"))
    assert table.versions() == []
    frame = lambda rows: spark.createDataFrame(rows, "id string, source string, v array<float>")
    first = table.upsert(frame([("a", "s", [1.0, 0.0]), ("b", "s", [0.0, 1.0])]), ["id"], "v", 2)
    table.upsert(frame([("b", "t", [1.0, 1.0])]).withColumn("extra", F.lit(1)), ["id"], "v", 2)
    assert {(r.id, r.source, r.extra) for r in table.read().collect()} == {("a", "s", None), ("b", "t", 1)}
    with pytest.raises(ValueError):
        table.upsert(frame([("c", "s", [1.0])]), ["id"], "v", 2)
    table.restore(first)
    assert {(r.id, r.source) for r in table.read().collect()} == {("a", "s"), ("b", "s")}
    rows = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("t", None, "c"), (None, 1, "d")], "source string, run int, id string")
    assert {r.id for r in collection.versioned_swap(rows, "source", "run").collect()} == {"b", "c"}
    assert {r.id for r in collection.delete_where(rows, "source", "s", ("run", 2)).collect()} == {"b", "c", "d"}


@pytest.mark.parametrize(
    "name, access, link, phase",
    [("X", None, None, 4), ("X", "contact owner", "http://a.b/c.nc", 4), ("X", "Open", "https://cds.climate.copernicus.eu/d", 3), ("X", "open", "http://a.b/c.nc", 1), ("X", "upon registration", "http://a.b/c.csv", 2), ("X", "Open", "http://a.b/page", 1), ("MSWEP", "open", "http://a.b/c.nc", 4), ("X", "open", "http://a or http://b", 4), ("X", "", "http://a.b/page", 4)],
)
def test_phase(spark, name, access, link, phase):
    row = spark.createDataFrame([(name, access, link)], "n string, a string, l string")
    assert row.select(catalog.phase(F.col("n"), F.col("a"), F.col("l")).alias("p")).first().p == phase


def test_texts(spark):
    row = spark.createDataFrame([("--Ab c/D é--", "between 2005 to 1999", "in 2021, not 1850", b"CDF\x01xxxx", b"<!DOCTYPE html>")], "s string, a string, b string, m binary, h binary")
    found = row.select(texts.slugify(F.col("s")).alias("slug"), texts.years(F.col("a")).alias("a"), texts.years(F.col("b")).alias("b"), texts.magic_format(F.col("m")).alias("m"), texts.is_html(F.col("h")).alias("h"), texts.magic_format(F.lit(b"ab")).alias("few")).first()
    assert (found.slug, tuple(found.a), tuple(found.b), found.m, found.h, found.few) == ("ab_c_d", (1999, 2005), (2021, 2021), "netcdf", True, None)


def test_year_overlap(spark):
    rows = spark.createDataFrame([(1, "2000-05-01", "2001-01-01"), (2, None, "1999-12-31"), (3, "", ""), (4, "2003-01-01T00:00", None), (5, None, None)], "i int, a string, b string")
    assert {r.i for r in rows.where(relate.year_overlap(F.col("a"), F.col("b"), 2000, 2002)).collect()} == {1, 3, 5}


def test_streams_equal_batches(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = tmp_path / "in"
    batch.repartition(3).write.parquet(str(folder))
    stream = spark.readStream.schema(batch.schema).parquet(str(folder))
    for name, run, mode in (
        ("tumbled", lambda df: events.tumbling(df, "ts", "1 day", "event_type", "value", "60 days"), "complete"),
        ("slid", lambda df: events.sliding(df, "ts", "2 days", "1 day", "event_type", "60 days"), "complete"),
    ):
        found = events.run_available(run(stream.withColumn("ts", F.col("ts").cast("timestamp"))), name, str(tmp_path / name), mode)
        assert {tuple(r) for r in found.collect()} == {tuple(r) for r in run(batch.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}


def test_directory_is_ingested_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.csv").write_text("1,2\n")
    run = lambda: events.ingest_directory(spark, str(folder), "x int, y int", lambda batch, n: seen.extend(r.x for r in batch.collect()), str(tmp_path / "done"))
    run()
    (folder / "b.csv").write_text("3,4\n")
    run()
    assert seen == [1, 3]


def test_fan_out_deals_a_key_over_tasks(spark):
    left = spark.createDataFrame([(i, None if i % 50 == 7 else i % 50 == 3) for i in range(600)], "a long, k boolean").select("a", F.col("k").cast("int").alias("k")).coalesce(1)
    right = spark.createDataFrame([(i, 0 if i % 9 else None) for i in range(90)] + [(500, 1), (501, 1), (502, 5)], "b long, l int")
    pairs = relate.fan_out(left, right, "k", "l", each=1000)
    want = left.join(right, F.col("k") == F.col("l"))
    assert pairs.columns == want.columns and sorted(map(tuple, pairs.collect())) == sorted(map(tuple, want.collect()))
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < pairs.count() / 3
    assert relate.fan_out(left.limit(0), right, "k", "l").count() == 0


def test_fan_out_shuffles_no_copies(spark):
    left = spark.range(300).selectExpr("id a", "cast(nullif(id % 4, 3) as int) k")
    right = spark.range(120).selectExpr("id b", "cast(nullif(id % 3, 2) as int) l")
    want = sorted(map(tuple, left.join(right, F.col("k") == F.col("l")).collect()))
    for most, parts in ((1000, 8), (30, 8), (30, 1), (1, 1)):
        pairs = relate.fan_out(left, right, "k", "l", each=50, most=most, parts=parts)
        assert sorted(map(tuple, pairs.collect())) == want
        copied = "Generate" in pairs._jdf.queryExecution().optimizedPlan().toString()
        assert copied == (parts == 1)  # right rows were copied for each cell whatever their number
