"""The inverted file of vectors against the full scan."""

import glob
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isopleth.operators import retrieve, vectorindex
from isopleth.operators.vectorindex import VectorIndex, centroids
from isopleth.plans import registry
from tests.oracle import compare, connect


def recall(found, best):
    true = {(r.query_id, r.id) for r in best}
    return len(true & {(r.query_id, r.id) for r in found}) / len(true)


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """4,000 points around 40 centres, a third of them copies of one, some without or with a zero vector."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[0] if i % 3 == 0 else centres[i % 40] + 0.5 * rng.normal(size=16)).tolist(), i % 5) for i in range(4000)]
    rows[7], rows[8] = (7, [0.0] * 16, 1), (8, None, 1)
    points = spark.createDataFrame(rows, "id long, embedding array<float>, label int").repartition(6)
    return points, VectorIndex.build(points, str(tmp_path_factory.mktemp("index")), target=0.93)


def test_recall_of_the_probes(spark, clustered):
    points, index = clustered
    queries = points.where("id % 50 = 1").withColumnRenamed("id", "query_id")
    best = retrieve.knn(queries, points, 10, ["label"]).collect()
    found = index.search(queries, 10, ["label"]).collect()
    assert recall(found, best) >= 0.9 and index.recall >= 0.93 and index.probes < len(index.centroids) / 2
    one = queries.where("query_id = 51")
    assert index.visited(one) < 0.6
    scores = {(r.query_id, r.id): (r.score, r.label) for r in retrieve.knn(queries, points, 4000, ["label"]).collect()}
    assert all(scores[r.query_id, r.id] == (r.score, r.label) for r in found)
    assert int(index.sizes.sum()) == 3999


@pytest.mark.parametrize("probes", [1, 3, None])
def test_exact_search_equals_the_scan(spark, clustered, probes):
    points, index = clustered
    queries = points.where("id % 40 = 1 or id < 9").withColumnRenamed("id", "query_id")
    best = sorted(map(tuple, retrieve.knn(queries, points, 10, ["label"]).collect()))
    assert sorted(map(tuple, index.search(queries, 10, ["label"], probes=probes, exact=True).collect())) == best
    assert index.search(queries.limit(0), 10, exact=True).count() == 0


def test_only_probed_lists_are_read(spark, clustered, tmp_path):
    points, index = clustered
    one = points.where("id = 51").withColumnRenamed("id", "query_id")
    plan = index.search(one, 5, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan
    folders = glob.glob(f"{index.folder}/points/list=*")
    assert len(folders) == int((index.sizes > 0).sum())


def test_edges(spark, tmp_path):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, embedding array<float>")
    index = VectorIndex.build(points, str(tmp_path / "a"), lists=9)
    queries = points.withColumnRenamed("id", "query_id")
    assert sorted((r.query_id, r.rank, r.id) for r in index.search(queries, 2, exact=True).collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (3, 1, 3), (3, 2, 1)]
    assert VectorIndex.build(points.limit(0), str(tmp_path / "b")).search(queries, 2).count() == 0
    assert np.allclose(np.linalg.norm(centroids(np.eye(4), 3), axis=1), 1)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_search(spark, sf):
    sf = f"/root/testdata/{sf}"
    assert compare(spark, connect(sf), sf, registry.queries()["knn_indexed_exact"], registry.oracle_sql()["knn_indexed_exact"]) > 0
    best = registry.queries()["knn_topk"](spark, sf).collect()
    assert recall(registry.queries()["knn_indexed"](spark, sf).collect(), best) >= 0.9


def test_memory_of_placing_and_bounding_is_bounded():
    rng = np.random.default_rng(5)
    coarse = rng.normal(size=(4096, 8))
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=80_000).astype(np.float32)), 8).cast(pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), vectors, pa.array(np.full(10_000, 0.9))], ["id", "embedding", "least"])
    for run in (vectorindex._placing(coarse, 1), vectorindex._bounded(coarse, np.zeros(4096), np.ones(4096, int), 4)):
        tracemalloc.start()
        assert sum(b.num_rows for b in run([batch])) >= 10_000
        assert tracemalloc.get_traced_memory()[1] < 100_000_000  # 10,000 x 4,096 products alone are 328 MB
        tracemalloc.stop()
