"""Retrieval over a vector collection: nearest neighbours, fusion, quotas, diversity.

Ranked lists are one long frame (query_id, list_id, rank, id, score, ...); every ranking breaks ties by id.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors in one block, points in one pack, blocks that may be broadcast, and scores that are held at once.
BLOCK, PACK, BLOCKS, SCORES = 1024, 8192, 16, 1 << 20


def cosine(a: str, b: str) -> Column:
    """Cosine similarity of two vectors in double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _packed(rows: DataFrame, number: str, size: int, vector: str | None = None) -> DataFrame:
    """number, data: runs of up to `size` rows of the same number as one binary value each, in the order of a partition.

    Rows without a vector, where its column is named, are left out here: a condition on the column would have a model that gives it asked twice.
    """

    def run(batches):
        held, key, count = [], None, 0

        def close():
            table = pa.Table.from_batches(held).combine_chunks()
            return pa.RecordBatch.from_pydict({"number": pa.array([key], pa.int32()), "data": pa.array([_ipc(table.to_batches()[0])], pa.binary())})

        for batch in batches:
            if vector:
                batch = batch.filter(batch.column(batch.schema.get_field_index(vector)).is_valid())
            numbers, at = batch.column(0).to_numpy(), 0
            while at < batch.num_rows:
                same = int(np.argmax(np.append(numbers[at:] != numbers[at], True)))
                if held and (numbers[at] != key or count >= size):
                    yield close()
                    held, count = [], 0
                key, take = int(numbers[at]), min(same, size - count if held else size)
                held.append(batch.slice(at, take))
                at, count = at + take, count + take
        if held:
            yield close()

    return rows.withColumnRenamed(number, "number").mapInArrow(run, "number int, data binary")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows at unit length; zeros stay."""
    return m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)


def _slices(rows: int, columns: int):
    """Runs of rows whose products with that many columns have about SCORES entries."""
    size = max(1, SCORES // max(1, columns))
    return (slice(at, at + size) for at in range(0, rows, size))


def _foremost(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest finite scores of each row, best first, of equal ones the first columns; none of a whole row is sorted."""
    scores[~np.isfinite(scores)] = -np.inf
    few = min(k, scores.shape[1])
    if not few:
        return np.zeros(0, int), np.zeros(0, int)
    least = np.partition(scores, scores.shape[1] - few, axis=1)[:, scores.shape[1] - few]
    row, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _scorer(query_id: str, vector: str, id_col: str, keep: list[str], k: int, same=None):
    """For mapInArrow: pairs of packed queries and packed points to the k best points of each query among them.

    A block meets a pack in slices of queries, so what a worker holds depends neither on the block nor on the pack.
    """

    def best(batches):
        for batch in batches:
            for block, pack in zip(batch.column(0), batch.column(1)):
                q, p = (pa.ipc.open_stream(x.as_buffer()).read_all() for x in (block, pack))
                ids = p[id_col].to_pandas().to_numpy()
                # of equal scores the smaller ids come first, as points are in their order
                by_id = np.argsort(ids, kind="stable")
                names, ids = q[query_id].to_pandas().to_numpy(), ids[by_id]
                left, right = _unit(_matrix(q[vector])), _unit(_matrix(p[vector]))[by_id].T
                kept = {f: p[f].to_pandas().to_numpy()[by_id] for f in keep}
                own, other = (q[same[0]].to_pandas().to_numpy(), p[same[1]].to_pandas().to_numpy()[by_id]) if same else (None, None)
                for part in _slices(*left.shape[:1], right.shape[1]):
                    scores = left[part] @ right
                    np.round(scores, 6, out=scores)
                    scores += 0.0
                    if same:
                        scores[own[part, None] != other[None, :]] = -np.inf
                    at, c = _foremost(scores, k)
                    yield pa.RecordBatch.from_pandas(pd.DataFrame({"query_id": names[part][at], "id": ids[c], "score": scores[at, c], **{f: x[c] for f, x in kept.items()}}), preserve_index=False)

    return best


def _result(queries: DataFrame, points: DataFrame, query_id: str, id_col: str, fields: list) -> str:
    return ", ".join([f"query_id {queries.schema[query_id].dataType.simpleString()}", f"id {points.schema[id_col].dataType.simpleString()}", "score double", *(f"{f.name} {f.dataType.simpleString()}" for f in fields)])


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(queries: DataFrame, points: DataFrame, k: int, keep: list[str] = (), query_id: str = "query_id", vector: str = "embedding", id_col: str = "id", same=None) -> DataFrame:
    """The k points most alike by cosine to each query: query_id, id, score (6 places), rank from 1, and `keep` columns.

    Queries are packed into blocks, points into packs, each one binary row; a pack meets every block once, as one matrix
    product that hands on k rows per query at most. So the points are read once whatever the number of queries, nothing
    comes to the driver but the queries' count, and the shuffle carries k rows per query and pack. Blocks are
    broadcast while they are few; beyond BLOCKS they come by a shuffled join. same: an optional (query column, point
    column) pair that must be equal. Vectors must have one length; a missing one matches nothing.
    """
    fields = [f for f in points.schema.fields if f.name in keep]
    wanted = [query_id, vector] + ([same[0]] if same else [])
    rows = queries.select(*wanted).where(F.col(vector).isNotNull())
    blocks = max(1, -(-rows.count() // BLOCK))
    ddl = _result(queries, points, query_id, id_col, fields)
    columns = list(dict.fromkeys([id_col, vector, *(f.name for f in fields), *([same[1]] if same else [])]))
    numbered = rows.select(F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int").alias("_block"), *wanted).repartition(blocks, "_block").sortWithinPartitions("_block")
    asked = _packed(numbered, "_block", 1 << 30, vector).withColumnRenamed("data", "queries")
    packs = _packed(points.select(F.lit(0).alias("_pack"), *columns), "_pack", PACK, vector).select("data", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("number"))
    both = packs.join(F.broadcast(asked) if blocks <= BLOCKS else asked, "number").select("queries", "data")

    found = both.mapInArrow(_scorer(query_id, vector, id_col, [f.name for f in fields], k, same), ddl)
    return _first(found, k)


def grouped_topk(hits: DataFrame, key: str, group_size: int, group_limit: int) -> DataFrame:
    """The first group_size hits per key, of the group_limit keys of the best score: adds group_rank and place."""
    within = Window.partitionBy("query_id", key).orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("place", F.row_number().over(within)).where(F.col("place") <= group_size)
    ranked = ranked.withColumn("best", F.max("score").over(Window.partitionBy("query_id", key)))
    ranked = ranked.withColumn("group_rank", F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("best"), key)))
    return ranked.where(F.col("group_rank") <= group_limit).drop("best")


def rrf_fuse(lists: DataFrame, weights: dict[int, float], k: int = 60, least: float = 0.4) -> DataFrame:
    """Weighted reciprocal rank fusion of lists (ranks from 1): rrf, and score of the first list that has the hit.

    Weights belong to list ids, so an empty list shifts none. Hits under `least` of the best fused score go.
    """
    weight = F.coalesce(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("list_id")], F.lit(1.0))
    fused = lists.groupBy("query_id", "id").agg(F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("rrf"), F.min_by("score", "list_id").alias("score"), *(F.min_by(c, "list_id").alias(c) for c in lists.columns if c not in ("query_id", "id", "rank", "score", "list_id")))
    top = F.max("rrf").over(Window.partitionBy("query_id"))
    return fused.withColumn("top", top).where(F.col("rrf") >= least * F.col("top")).drop("top")


def grouped_list(hits: DataFrame, key: str = "dataset", group_size: int = 2, groups: int = 15) -> DataFrame:
    """A ranked list of its own from another: the first hits of each key, key by key, the keys with the best scores first (ties by the list's order); rank from 1."""
    within = Window.partitionBy("query_id", key)
    some = hits.withColumn("_n", F.row_number().over(within.orderBy("rank"))).where(F.col("_n") <= group_size)
    some = some.withColumns({"_best": F.max("score").over(within), "_first": F.min("rank").over(within)})
    some = some.withColumn("_group", F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("_best"), "_first"))).where(F.col("_group") <= groups)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_group", "_n"))).drop("_n", "_best", "_first", "_group")


def diversity_quota(hits: DataFrame, per_source: int = 3, per_pair: int = 2, tie: str = "id") -> DataFrame:
    """At most per_pair data hits per (source, variable) and then per_source hits per source, best first; summaries count for their source alone."""
    order = [F.desc("score"), F.col(tie)]
    pair = F.row_number().over(Window.partitionBy("query_id", "source", "variable", "is_summary").orderBy(*order))
    source = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(*order))
    kept = hits.withColumn("pair_place", pair).where(F.col("is_summary") | (F.col("pair_place") <= per_pair)).drop("pair_place")
    return kept.withColumn("source_place", source).where(F.col("source_place") <= per_source).drop("source_place")


def min_source_backfill(chosen: DataFrame, hits: DataFrame, least: int = 4, tie: str = "id") -> DataFrame:
    """chosen, and the best hits of sources it lacks until a query has `least` sources: adds backfilled."""
    have = chosen.groupBy("query_id").agg(F.countDistinct("source").alias("have"))
    best = hits.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), tie))).where("r = 1").drop("r")
    new = best.join(chosen.select("query_id", "source").distinct(), ["query_id", "source"], "left_anti").join(have, "query_id", "left")
    new = new.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), tie))).where(F.col("r") + F.coalesce("have", F.lit(0)) <= least)
    return chosen.withColumn("backfilled", F.lit(False)).unionByName(new.select(*chosen.columns).withColumn("backfilled", F.lit(True)))


def chosen_order(lists: DataFrame, weights: dict[int, float], boosted: Column, per_source: int = 3, per_pair: int = 2, sources: int = 4, guaranteed: int = 3) -> DataFrame:
    """What a search makes of its ranked lists, in order: query_id, id, score, source, variable, dataset, is_summary, place from 1.

    Lists are fused; where `boosted`, a column of the lists that is the same for a query, data come before summaries. Quotas take
    hits by their own scores, in that order where scores are equal. Sources are filled up from the fused hits, then, where there
    are still fewer than guaranteed, from all lists by score; what is filled in comes last.
    """
    flagged = lists.select("query_id", "list_id", "id", "score", "rank", "source", "variable", "dataset", "is_summary", boosted.alias("_boost"))
    fused = rrf_fuse(flagged, weights)
    summary_last = F.when(F.col("_boost") & F.col("is_summary"), 1).otherwise(0)
    fused = fused.withColumn("_fused", F.row_number().over(Window.partitionBy("query_id").orderBy(summary_last, F.desc("rrf"), "id"))).drop("rrf", "_boost")
    filled = min_source_backfill(diversity_quota(fused, per_source, per_pair, "_fused"), fused, sources, "_fused")
    filled = filled.withColumn("_step", F.col("backfilled").cast("int")).drop("backfilled")
    others = lists.groupBy("query_id", "id").agg(*(F.min_by(c, F.struct("list_id", "rank")).alias(c) for c in ("score", "source", "variable", "dataset", "is_summary"))).withColumns({"_fused": F.lit(None).cast("int"), "_step": F.lit(2)})
    whole = min_source_backfill(filled, others, guaranteed).drop("backfilled")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_step", F.desc("score"), F.coalesce("_fused", F.lit(0)), "id"))
    return whole.withColumn("place", place).select("query_id", "id", "score", "source", "variable", "dataset", "is_summary", "place")


def mmr(hits: DataFrame, take: int, balance: float = 0.55, source: str = "source", dataset: str = "dataset", variable: str = "variable", order: str | None = None) -> DataFrame:
    """Maximal marginal relevance per query on a bounded candidate list: adds mmr_rank from 1.

    Likeness of two hits is 0.5 for the same source, 0.3 for the same dataset and 0.2 for the same variable. Where a query has no more than `take` hits they keep
    their order. Candidates come by `order`, else best first (ties by id), and the first of equally good ones is taken.
    """

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        by = [order] if order else ["score", "id"]
        frame = frame.sort_values(by, ascending=[True] if order else [False, True], kind="stable").reset_index(drop=True)
        if len(frame) <= take:
            return frame.assign(mmr_rank=np.arange(1, len(frame) + 1, dtype=np.int32))
        keys = [pd.factorize(frame[c], use_na_sentinel=False)[0] for c in (source, dataset, variable)]
        like, free, chosen = np.zeros(len(frame)), np.ones(len(frame), bool), []
        while len(chosen) < take:
            gain = np.where(free, balance * frame["score"].to_numpy() - (1 - balance) * like, -np.inf)
            at = int(np.argmax(gain))
            chosen.append(at)
            free[at] = False
            like = np.maximum(like, sum(w * (k == k[at]) for w, k in zip((0.5, 0.3, 0.2), keys)))
        return frame.loc[chosen].assign(mmr_rank=np.arange(1, take + 1, dtype=np.int32))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields) + ", mmr_rank int"
    return hits.groupBy("query_id").applyInPandas(pick, schema)


def data_boost(hits: DataFrame) -> DataFrame:
    """Data chunks before summaries, each in score order: adds place from 1."""
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("is_summary", F.desc("score"), "id")))


def source_guarantee(chosen: DataFrame, lists: DataFrame, least: int = 3) -> DataFrame:
    """chosen, and from all ranked lists the best hits of sources it lacks until a query has `least` sources."""
    hits = lists.groupBy("query_id", "id", "source").agg(F.max("score").alias("score"))
    extra = [c for c in chosen.columns if c not in hits.columns]
    hits = hits.select("*", *(F.lit(None).cast(chosen.schema[c].dataType).alias(c) for c in extra))
    return min_source_backfill(chosen, hits, least).drop("backfilled")
