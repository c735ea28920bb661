"""Retrieval quality: ranking metrics per query and over queries, similarity within and between groups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """Per query and k: hit, reciprocal rank, NDCG with binary gains and recall at k.

    ranked: query_id, id, rank from 1. relevant: query_id, id. Queries without a relevant item give no row.
    """
    counts = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    marked = ranked.join(relevant.withColumn("rel", F.lit(1)), ["query_id", "id"], "left").join(counts, "query_id")
    return marked_metrics(marked.withColumn("rel", F.coalesce("rel", F.lit(0))), ks)


def marked_metrics(marked: DataFrame, ks: list[int]) -> DataFrame:
    """The same where each ranked item is marked: query_id, rank, rel (0 or 1), n_relevant. Relevant pairs are never formed."""
    marked = marked.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.col("k")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    found = marked.groupBy("query_id", "k", "n_relevant").agg(
        F.max("rel").cast("double").alias("hit"), F.max(F.col("rel") / F.col("rank")).alias("mrr"),
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum("rel").alias("n_found"),
    )
    return found.select("query_id", "k", "hit", F.round("mrr", 6).alias("mrr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"), F.round(F.col("n_found") / F.col("n_relevant"), 6).alias("recall"))


def centroids(points: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean of each vector component per key: key, pos (from 0), mean."""
    parts = points.select(key, F.posexplode(vector).alias("pos", "value"))
    return parts.groupBy(key, "pos").agg(F.round(F.avg(F.col("value").cast("double")), 6).alias("mean"))


def group_similarity(points: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean cosine similarity of unit vectors within each group, and of its members to all other points.

    By sums of vectors, linear in the points: the sum over all pairs of dot products is the square of the sum.
    """
    unit = points.select(F.col(key).alias("key"), F.posexplode(vector).alias("pos", "value")).select("key", "pos", F.col("value").cast("double").alias("v"))
    sums = unit.groupBy("key", "pos").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("own"), F.count("*").alias("n"))
    all_sums = sums.groupBy("pos").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    per = sums.join(all_sums, "pos").groupBy("key").agg(
        F.sum(F.col("s") * F.col("s")).alias("within"), F.sum("own").alias("own"), F.sum(F.col("s") * (F.col("all_s") - F.col("s"))).alias("between"), F.max("n").alias("n"), F.max("all_n").alias("all_n"),
    )
    return per.select(F.col("key").alias(key), F.round((F.col("within") - F.col("own")) / (F.col("n") * (F.col("n") - 1)), 6).alias("intra"), F.round(F.col("between") / (F.col("n") * (F.col("all_n") - F.col("n"))), 6).alias("inter"))
