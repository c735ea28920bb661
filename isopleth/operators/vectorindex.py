"""An inverted file of vectors: points in lists of coarse centroids, searched in a few lists, scored exactly."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from isopleth.operators.retrieve import BLOCK, BLOCKS, PACK, _first, _matrix, _packed, _result, _scorer, _slices, _unit, knn
from isopleth.sources.store import Store


def centroids(vectors: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors by k-means on the sphere; one that loses all its vectors takes the worst placed one."""
    rng = np.random.default_rng(seed)
    found = vectors[rng.choice(len(vectors), min(lists, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        nearest, best = np.zeros(len(vectors), int), np.zeros(len(vectors))
        for part in _slices(len(vectors), len(found)):
            likeness = vectors[part] @ found.T
            nearest[part], best[part] = likeness.argmax(axis=1), likeness.max(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, vectors)
        empty = np.flatnonzero(np.bincount(nearest, minlength=len(found)) == 0)
        if len(empty):
            sums[empty] = vectors[np.argsort(best, kind="stable")[: len(empty)]]
        found = _unit(sums)
    return found


class VectorIndex:
    """Points in a folder, a partition per list, and a small file of centroids, radii, sizes and probes.

    The coarse centroids come from a bounded sample; every point is in the list of its nearest centroid. A search reads
    the `probes` lists nearest to each query, as partitions, and scores their points exactly. How many that takes was
    measured when the index was built. With exact=True more lists are read as needed: a list can only hold a better point
    if the query's angle to its centroid, less the list's radius, is smaller than to the k-th point found; so the result
    equals the full scan's.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        about = json.loads(Store(spark, folder).read_text(f"{self.folder}/lists.json"))
        self.centroids, self.radii, self.sizes = (np.array(about[c]) for c in ("centroids", "radii", "sizes"))
        self.probes, self.recall, self.id_col, self.vector = about["probes"], about["recall"], about["id"], about["vector"]
        self.points = spark.read.schema(StructType.fromJson(about["schema"])).parquet(f"{self.folder}/points")

    @classmethod
    def build(cls, points: DataFrame, folder: str, id_col: str = "id", vector: str = "embedding", lists: int | None = None, sample: int = 20_000, target: float = 0.95, trials: int = 200, k: int = 10) -> VectorIndex:
        """Writes the index of all points; rows without a vector are left out.

        lists: by default the square root of the points' number, at most 4,096. Centroids are fitted to at most `sample`
        points, the probes to `trials` of these: the fewest lists that find `target` of their k nearest, as the full
        scan has them. Large lists are written in several files, by Spark's rebalancing.
        """
        spark, folder = points.sparkSession, folder.rstrip("/")
        points = points.where(F.col(vector).isNotNull())
        n = points.count()
        lists = max(1, min(lists or round(n**0.5), 4096, n))
        rows = points.select(id_col, vector).orderBy(F.xxhash64(id_col), id_col).limit(sample).toPandas()
        some = _unit(np.array(rows[vector].tolist(), np.float64)) if n else None
        coarse = centroids(some, lists) if n else np.zeros((1, 1))
        placed = points.mapInArrow(_placing(coarse, points.columns.index(vector)), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in points.schema.fields)}, list int, _angle double")
        placed.hint("rebalance", "list").write.partitionBy("list").parquet(f"{folder}/points")
        written = spark.read.schema(placed.schema).parquet(f"{folder}/points")
        stats = {r.list: r for r in written.groupBy("list").agg(F.max("_angle").alias("radius"), F.count("*").alias("n")).collect()}
        about = {
            "id": id_col, "vector": vector, "centroids": coarse.tolist(), "radii": [float(stats[i].radius) if i in stats else 0.0 for i in range(len(coarse))], "sizes": [stats[i].n if i in stats else 0 for i in range(len(coarse))], "probes": 1, "recall": 1.0, "schema": json.loads(placed.schema.json()),
        }
        if n:
            trial = rows.iloc[:trials]
            asked = spark.createDataFrame(pd.DataFrame({"query_id": np.arange(len(trial)), "embedding": [list(map(float, v)) for v in trial[vector]]}), "query_id long, embedding array<double>")
            best = knn(asked, written.withColumnRenamed(vector, "embedding"), k, ["list"], id_col=id_col).select("query_id", "list").toPandas()
            # the place of the list of each true neighbour among the lists by nearness: so many probes find it
            order = np.argsort(np.argsort(-(some[: len(trial)] @ coarse.T), axis=1, kind="stable"), axis=1)
            needed = np.sort(order[best["query_id"].to_numpy(), best["list"].to_numpy()]) + 1
            about["probes"] = int(needed[max(0, int(np.ceil(target * len(needed))) - 1)])
            about["recall"] = float((needed <= about["probes"]).mean())
        Store(spark, folder).write_new(f"{folder}/lists.json", json.dumps(about))
        return cls(spark, folder)

    def search(self, queries: DataFrame, k: int, keep: list[str] = (), query_id: str = "query_id", vector: str = "embedding", probes: int | None = None, exact: bool = False) -> DataFrame:
        """The k points most alike to each query, as retrieve.knn gives them, from the lists probed."""
        asked = queries.select(query_id, vector).where(F.col(vector).isNotNull())
        probes = min(probes or self.probes, len(self.centroids))
        near = asked.mapInArrow(_probing(self.centroids, probes), self._asked(queries, query_id, vector))
        found = self._score(near, queries, k, keep, query_id, vector)
        if not exact or probes == len(self.centroids):
            return _first(found, k)
        least = _first(found, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("least"))
        rest = asked.join(least.withColumnRenamed("query_id", query_id), query_id, "left")
        more = rest.mapInArrow(_bounded(self.centroids, self.radii, self.sizes, probes), self._asked(queries, query_id, vector))
        return _first(found.unionByName(self._score(more, queries, k, keep, query_id, vector)), k)

    def visited(self, queries: DataFrame, probes: int | None = None, vector: str = "embedding") -> float:
        """The share of the points that a search of these queries reads, lists read for several queries once each."""
        near = queries.select(F.lit(0).alias("q"), vector).mapInArrow(_probing(self.centroids, min(probes or self.probes, len(self.centroids))), self._asked(queries.select(F.lit(0).alias("q"), vector), "q", vector))
        return sum(int(self.sizes[r.list]) for r in near.select("list").distinct().collect()) / max(1, int(self.sizes.sum()))

    @staticmethod
    def _asked(queries: DataFrame, query_id: str, vector: str) -> str:
        return f"list int, `{query_id}` {queries.schema[query_id].dataType.simpleString()}, `{vector}` {queries.schema[vector].dataType.simpleString()}"

    def _score(self, near: DataFrame, queries: DataFrame, k: int, keep: list[str], query_id: str, vector: str) -> DataFrame:
        """(list, query) pairs to the k best points of each pack; only lists that are asked for are read."""
        fields = [f for f in self.points.schema.fields if f.name in keep]
        wanted = [r.list for r in near.select("list").distinct().collect()]  # at most as many as there are lists
        points = self.points.where(F.col("list").isin(wanted)) if len(wanted) < len(self.centroids) else self.points
        points = points.withColumnRenamed(self.vector, vector) if self.vector != vector else points
        columns = list(dict.fromkeys([self.id_col, vector, *(f.name for f in fields)]))
        packs = _packed(points.select("list", *columns), "list", PACK)
        blocks = _packed(near.repartition("list").sortWithinPartitions("list"), "list", BLOCK).withColumnRenamed("data", "queries")
        few = near.count() <= BLOCK * BLOCKS
        both = packs.join(F.broadcast(blocks) if few else blocks, "number").select("queries", "data")
        return both.mapInArrow(_scorer(query_id, vector, self.id_col, [f.name for f in fields], k), _result(queries, self.points, query_id, self.id_col, fields))


def _likeness(vectors: pa.Array, coarse: np.ndarray) -> np.ndarray:
    """Cosines to the centroids; an index without points has one of no meaning."""
    found = _unit(_matrix(vectors))
    return found @ coarse.T if found.shape[1] == coarse.shape[1] else np.zeros((len(found), len(coarse)))


def _parts(batches, coarse: np.ndarray):
    """Batches in slices of so many vectors that their likeness to all centroids stays small, however many lists there are."""
    for batch in batches:
        for part in _slices(batch.num_rows, len(coarse)):
            yield batch.slice(part.start, part.stop - part.start)


def _placing(coarse: np.ndarray, vector: int):
    def place(batches):
        for batch in _parts(batches, coarse):
            likeness = _likeness(batch.column(vector), coarse)
            nearest = likeness.argmax(axis=1)
            angle = np.arccos(np.clip(likeness[np.arange(len(nearest)), nearest], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32()), pa.array(angle)], [*batch.schema.names, "list", "_angle"])

    return place


def _pairs(batch: pa.RecordBatch, chosen: np.ndarray, most: int = 16_384):
    """A row per query and list that is chosen for it, in batches of at most `most`."""
    at, lists = np.nonzero(chosen)
    for start in range(0, len(at), most):
        rows = pa.array(at[start : start + most])
        yield pa.RecordBatch.from_arrays([pa.array(lists[start : start + most], pa.int32()), batch.column(0).take(rows), batch.column(1).take(rows)], ["list", *batch.schema.names[:2]])


def _nearest(batch: pa.RecordBatch, coarse: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    likeness = _likeness(batch.column(1), coarse)
    near = np.zeros(likeness.shape, bool)
    np.put_along_axis(near, np.argsort(-likeness, axis=1, kind="stable")[:, :probes], True, axis=1)
    return likeness, near


def _probing(coarse: np.ndarray, probes: int):
    def probe(batches):
        for batch in _parts(batches, coarse):
            yield from _pairs(batch, _nearest(batch, coarse, probes)[1])

    return probe


def _bounded(coarse: np.ndarray, radii: np.ndarray, sizes: np.ndarray, probes: int):
    """Lists beyond the probed ones that may hold a point as good as the k-th; scores have six places."""

    def rest(batches):
        for batch in _parts(batches, coarse):
            likeness, near = _nearest(batch, coarse, probes)
            least = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            least = np.where(np.isnan(least), -2.0, least)
            norms = np.linalg.norm(_matrix(batch.column(1)), axis=1)
            best = np.cos(np.maximum(np.arccos(np.clip(likeness, -1, 1)) - radii[None, :], 0))
            best[norms == 0] = 1.0
            # a list may also hold zero vectors, which score 0
            yield from _pairs(batch, ~near & (sizes[None, :] > 0) & (np.maximum(best, 0.0) + 1e-6 >= least[:, None]))

    return rest
