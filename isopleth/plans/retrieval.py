"""Registered retrieval queries over the embeddings: every vector whose id is divisible by 50 is a query.

A vector's label stands for its source, its id modulo 3 for its variable, modulo 7 for its dataset; every 11th is a summary.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.operators import evaluate, retrieve, vectorindex
from isopleth.plans.registry import register
from isopleth.sources.scratch import folder

KEEP = ["label"]


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "id")


def _queries(points: DataFrame) -> DataFrame:
    return points.where("id % 50 = 0").withColumnRenamed("id", "query_id")


def _nearest(spark, sf_dir, k=60, where=None) -> DataFrame:
    points = _points(spark, sf_dir)
    return retrieve.knn(_queries(points), points.where(where) if where else points, k, KEEP)


def _hits(spark, sf_dir, k=60) -> DataFrame:
    hits = _nearest(spark, sf_dir, k)
    return hits.select("query_id", "id", "score", "rank", F.concat(F.lit("s"), "label").alias("source"), F.concat(F.lit("v"), F.col("id") % 3).alias("variable"), F.concat(F.lit("d"), F.col("id") % 7).alias("dataset"), (F.col("id") % 11 == 0).alias("is_summary"))


SCORED = """s AS (SELECT q.vec_id AS query_id, p.vec_id AS id, p.label AS label, q.label AS query_label,
  round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN embeddings p ON q.vec_id % 50 = 0)"""


def knn_sql(name: str = "knn", k: int = 60, where: str = "TRUE") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, id, label, score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s WHERE {where}) WHERE rank <= {k})"""


HITS = f"""WITH {SCORED}, {knn_sql()}, hits AS (SELECT query_id, id, score, rank, 's' || label AS source, 'v' || (id % 3) AS variable,
  'd' || (id % 7) AS dataset, id % 11 = 0 AS is_summary FROM knn)"""
FUSED = f"""WITH {SCORED}, {knn_sql("a")}, {knn_sql("b", 20, "label % 2 = 0")}, {knn_sql("c", 20, "id % 3 = 0")},
lists AS (SELECT 0 AS list_id, 1.0 AS w, * FROM a UNION ALL SELECT 1, 0.6, * FROM b UNION ALL SELECT 2, 0.9, * FROM c),
fused AS (SELECT query_id, id, label, round(sum(CAST(w AS DOUBLE) / (60 + rank)), 9) AS rrf, arg_min(score, list_id) AS score FROM lists GROUP BY 1, 2, 3)"""
QUOTA = """, pairs AS (SELECT *, row_number() OVER (PARTITION BY query_id, source, variable, is_summary ORDER BY score DESC, id) AS pair_place FROM hits),
sources AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS source_place FROM pairs WHERE is_summary OR pair_place <= 2),
chosen AS (SELECT query_id, id, score, rank, source, variable, dataset, is_summary FROM sources WHERE source_place <= 3)"""


@register("knn_topk", f"WITH {SCORED}, {knn_sql(k=10)} SELECT query_id, id, label, score, rank FROM knn")
def knn_topk(spark, sf_dir):
    """Exact nearest neighbours."""
    return _nearest(spark, sf_dir, 10).select("query_id", "id", "label", "score", "rank")


def _index(spark, sf_dir, **options):
    return vectorindex.VectorIndex.build(_points(spark, sf_dir), folder(spark, "index"), **options)


@register("knn_indexed")
def knn_indexed(spark, sf_dir):
    """Nearest neighbours from the lists nearest to each query; rows only, as a few true neighbours are missed (recall is tested)."""
    return _index(spark, sf_dir).search(_queries(_points(spark, sf_dir)), 10, KEEP).select("query_id", "id", "label", "score", "rank")


@register("knn_indexed_exact", f"WITH {SCORED}, {knn_sql(k=10)} SELECT query_id, id, label, score, rank FROM knn")
def knn_indexed_exact(spark, sf_dir):
    """The same index, reading on until no list can hold a better point."""
    return _index(spark, sf_dir).search(_queries(_points(spark, sf_dir)), 10, KEEP, exact=True).select("query_id", "id", "label", "score", "rank")


@register("knn_filtered_topk", f"WITH {SCORED}, {knn_sql(k=10, where='label = query_label')} SELECT query_id, id, label, score, rank FROM knn")
def knn_filtered_topk(spark, sf_dir):
    """Nearest neighbours of the query's own label."""
    points = _points(spark, sf_dir)
    queries = _queries(points).withColumnRenamed("label", "query_label")
    return retrieve.knn(queries, points, 10, KEEP, same=("query_label", "label")).select("query_id", "id", "label", "score", "rank")


@register("knn_batch", f"WITH {SCORED}, {knn_sql('a')}, {knn_sql('b', 20, 'label % 2 = 0')}, {knn_sql('c', 20, 'id % 3 = 0')} SELECT 0 AS list_id, query_id, id, score, rank FROM a UNION ALL SELECT 1, query_id, id, score, rank FROM b UNION ALL SELECT 2, query_id, id, score, rank FROM c")
def knn_batch(spark, sf_dir):
    """Several filtered searches of the same queries as one frame of ranked lists."""
    return _lists(spark, sf_dir).select("list_id", "query_id", "id", "score", "rank")


def _lists(spark, sf_dir):
    searches = [(0, 60, None), (1, 20, "label % 2 = 0"), (2, 20, "id % 3 = 0")]
    frames = [_nearest(spark, sf_dir, k, where).withColumn("list_id", F.lit(n)) for n, k, where in searches]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@register("grouped_topk", HITS + """, g AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS place FROM hits),
 b AS (SELECT *, max(score) OVER (PARTITION BY query_id, source) AS best FROM g WHERE place <= 2)
SELECT * FROM (SELECT query_id, id, source, score, CAST(place AS INTEGER) AS place, CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY best DESC, source) AS INTEGER) AS group_rank FROM b) WHERE group_rank <= 4""")
def grouped_topk(spark, sf_dir):
    """Two hits of each of the four best sources."""
    return retrieve.grouped_topk(_hits(spark, sf_dir), "source", 2, 4).select("query_id", "id", "source", "score", "place", "group_rank")


@register("rrf_fuse", FUSED + " SELECT query_id, id, label, rrf, score FROM (SELECT *, max(rrf) OVER (PARTITION BY query_id) AS top FROM fused) WHERE rrf >= 0.4 * top")
def rrf_fuse(spark, sf_dir):
    """Fusion of three ranked lists."""
    return retrieve.rrf_fuse(_lists(spark, sf_dir), {0: 1.0, 1: 0.6, 2: 0.9}).select("query_id", "id", "label", "rrf", "score")


@register("diversity_quota", HITS + QUOTA + " SELECT query_id, id, score, source, variable, is_summary FROM chosen")
def diversity_quota(spark, sf_dir):
    """Quotas by source and variable."""
    return retrieve.diversity_quota(_hits(spark, sf_dir)).select("query_id", "id", "score", "source", "variable", "is_summary")


@register("min_source_backfill", HITS.replace("FROM knn)", "FROM knn)") + """, few AS (SELECT * FROM hits WHERE rank <= 5), have AS (SELECT query_id, count(DISTINCT source) AS n FROM few GROUP BY 1),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS r FROM hits) WHERE r = 1),
 new AS (SELECT b.*, row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, b.id) AS place FROM best b WHERE NOT EXISTS (SELECT 1 FROM few f WHERE f.query_id = b.query_id AND f.source = b.source))
SELECT query_id, id, score, source, FALSE AS backfilled FROM few UNION ALL SELECT new.query_id, id, score, source, TRUE FROM new LEFT JOIN have USING (query_id) WHERE place + coalesce(n, 0) <= 4""")
def min_source_backfill(spark, sf_dir):
    """The five best hits, filled up to four sources."""
    hits = _hits(spark, sf_dir)
    return retrieve.min_source_backfill(hits.where("rank <= 5"), hits, 4).select("query_id", "id", "score", "source", "backfilled")


@register("source_guarantee", FUSED + """, top AS (SELECT query_id, id, score, 's' || label AS source FROM a WHERE rank <= 3), have AS (SELECT query_id, count(DISTINCT source) AS n FROM top GROUP BY 1), best AS (SELECT query_id, 's' || label AS source, id, max(score) AS score FROM lists GROUP BY 1, 2, 3),
 one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS r FROM best) WHERE r = 1), new AS (SELECT o.*, row_number() OVER (PARTITION BY o.query_id ORDER BY o.score DESC, o.id) AS place FROM one o WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.query_id = o.query_id AND t.source = o.source))
SELECT query_id, id, score, source FROM top UNION ALL SELECT new.query_id, id, score, source FROM new JOIN have USING (query_id) WHERE place + n <= 3""")
def source_guarantee(spark, sf_dir):
    """At least three sources per query, from all ranked lists."""
    lists = _lists(spark, sf_dir).withColumn("source", F.concat(F.lit("s"), F.col("label").cast("string")))
    chosen = lists.where("list_id = 0 and rank <= 3").select("query_id", "id", "score", "source")
    return retrieve.source_guarantee(chosen, lists, 3).select("query_id", "id", "score", "source")


@register("mmr")
def mmr(spark, sf_dir):
    """Maximal marginal relevance over the sixty nearest; tested against a plain loop."""
    return retrieve.mmr(_hits(spark, sf_dir), 20).select("query_id", "id", "score", "mmr_rank")


@register("data_boost", HITS + " SELECT query_id, id, is_summary, CAST(row_number() OVER (PARTITION BY query_id ORDER BY is_summary, score DESC, id) AS INTEGER) AS place FROM hits")
def data_boost(spark, sf_dir):
    """Data before summaries."""
    return retrieve.data_boost(_hits(spark, sf_dir)).select("query_id", "id", "is_summary", "place")


@register("union_dedup", FUSED + " SELECT query_id, id, CAST(count(*) AS BIGINT) AS lists FROM lists GROUP BY 1, 2")
def union_dedup(spark, sf_dir):
    """Union of ranked lists without repeats."""
    return _lists(spark, sf_dir).groupBy("query_id", "id").agg(F.count("*").alias("lists"))


@register("sets_overlap", FUSED + """ SELECT query_id, CAST(count(*) FILTER (WHERE n = 2) AS BIGINT) AS common, CAST(count(*) FILTER (WHERE n = 1 AND l = 1) AS BIGINT) AS only_first, CAST(count(*) FILTER (WHERE n = 1 AND l = 2) AS BIGINT) AS only_second
 FROM (SELECT query_id, id, count(*) AS n, min(list_id) AS l FROM lists WHERE list_id > 0 GROUP BY 1, 2) GROUP BY 1""")
def sets_overlap(spark, sf_dir):
    """Sizes of the intersection and differences of two lists."""
    ids = _lists(spark, sf_dir).where("list_id > 0").groupBy("query_id", "list_id").agg(F.collect_set("id").alias("ids"))
    both = ids.groupBy("query_id").agg(F.max(F.when(F.col("list_id") == 1, F.col("ids"))).alias("a"), F.max(F.when(F.col("list_id") == 2, F.col("ids"))).alias("b"))
    size = lambda c: F.size(c).cast("long")
    return both.select("query_id", size(F.array_intersect("a", "b")).alias("common"), size(F.array_except("a", "b")).alias("only_first"), size(F.array_except("b", "a")).alias("only_second"))


@register("retry_new_only", FUSED + """ SELECT c.query_id, c.id, c.score FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = c.query_id AND a.label = c.label AND a.id % 3 = c.id % 3 AND a.rank <= 10)""")
def retry_new_only(spark, sf_dir):
    """A retry's hits whose (source, variable) the first answer lacks."""
    lists = _lists(spark, sf_dir).withColumn("variable", F.col("id") % 3)
    first = lists.where("list_id = 0 and rank <= 10").select("query_id", "label", "variable").distinct()
    return lists.where("list_id = 2").join(first, ["query_id", "label", "variable"], "left_anti").select("query_id", "id", "score")


@register("retrieval_metrics", f"""WITH {SCORED}, {knn_sql(k=10)}, rel AS (SELECT q.vec_id AS query_id, count(*) AS n FROM embeddings q JOIN embeddings p ON q.label = p.label AND q.vec_id % 50 = 0 GROUP BY 1),
 marked AS (SELECT knn.query_id, k, rank, n, CASE WHEN knn.label = q.label THEN 1 ELSE 0 END AS rel FROM knn JOIN embeddings q ON q.vec_id = knn.query_id JOIN rel USING (query_id) CROSS JOIN (SELECT unnest([3, 5, 10]) AS k) ks WHERE rank <= k),
 ideal AS (SELECT m, sum(1 / log2(i + 1)) AS best FROM range(1, 11) a(m), range(1, 11) b(i) WHERE i <= m GROUP BY 1)
SELECT query_id, CAST(k AS INTEGER) AS k, CAST(max(rel) AS DOUBLE) AS hit, round(max(CAST(rel AS DOUBLE) / rank), 6) AS mrr,
 round(sum(rel / log2(rank + 1)) / any_value(best), 6) AS ndcg, round(CAST(sum(rel) AS DOUBLE) / any_value(n), 6) AS recall FROM marked JOIN ideal ON m = least(n, k) GROUP BY query_id, k""")
def retrieval_metrics(spark, sf_dir):
    """Ranking metrics where vectors of the query's label are relevant."""
    points = _points(spark, sf_dir).select("id", "label")
    counts = points.groupBy("label").agg(F.count("*").alias("n_relevant"))
    own = points.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("own")).join(counts.withColumnRenamed("label", "own"), "own")
    marked = _nearest(spark, sf_dir, 10).join(own, "query_id").withColumn("rel", (F.col("label") == F.col("own")).cast("int"))
    return evaluate.marked_metrics(marked, [3, 5, 10])


@register("label_centroids", "SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2")
def label_centroids(spark, sf_dir):
    """Centroid of each label."""
    return evaluate.centroids(_points(spark, sf_dir), "label")


@register("intra_inter_similarity", """WITH p AS (SELECT a.label AS label, a.label = b.label AS own, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS v FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT label, round(avg(v) FILTER (WHERE own), 6) AS intra, round(avg(v) FILTER (WHERE NOT own), 6) AS inter FROM p GROUP BY 1""")
def intra_inter_similarity(spark, sf_dir):
    """Mean similarity within labels and to other labels, without forming pairs."""
    return evaluate.group_similarity(_points(spark, sf_dir), "label")


SEARCH = """WITH near AS (SELECT q.vec_id AS query_id, l.list_id, p.vec_id AS id, p.label, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q CROSS JOIN (VALUES (0, 0), (2, 1), (100, 2), (101, 3)) l(list_id, ahead) JOIN embeddings a ON a.vec_id = q.vec_id + l.ahead CROSS JOIN embeddings p WHERE q.vec_id % 50 = 0 AND (l.list_id < 100 OR q.label % 2 = 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, list_id ORDER BY score DESC, id) AS rank FROM near),
plain AS (SELECT query_id, list_id, id, score, rank, 's' || label AS source, 'v' || (id % 3) AS variable, 'd' || (id % 7) AS dataset, id % 11 = 0 AS is_summary FROM placed WHERE rank <= CASE list_id WHEN 0 THEN 60 ELSE 20 END),
twos AS (SELECT *, row_number() OVER (PARTITION BY query_id, dataset ORDER BY rank) AS n, max(score) OVER (PARTITION BY query_id, dataset) AS best, min(rank) OVER (PARTITION BY query_id, dataset) AS first FROM plain WHERE list_id = 0),
grouped AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY best DESC, first) AS g FROM twos WHERE n <= 2),
lists AS (SELECT * FROM plain UNION ALL SELECT query_id, 1, id, score, row_number() OVER (PARTITION BY query_id ORDER BY g, n), source, variable, dataset, is_summary FROM grouped WHERE g <= 15),
summed AS (SELECT query_id, id, round(sum(CAST(CASE WHEN list_id < 2 THEN 1.0 WHEN list_id < 100 THEN 0.6 ELSE 0.9 END AS DOUBLE) / (60 + rank)), 9) AS rrf, arg_min(score, list_id) AS score, any_value(source) AS source, any_value(variable) AS variable, any_value(dataset) AS dataset, bool_or(is_summary) AS is_summary, max(list_id) >= 100 AS boosted FROM lists GROUP BY 1, 2),
boost AS (SELECT query_id, bool_or(list_id >= 100) AS boosted FROM lists GROUP BY 1),
best AS (SELECT *, max(rrf) OVER (PARTITION BY query_id) AS top FROM summed),
fused AS (SELECT f.* EXCLUDE (boosted), row_number() OVER (PARTITION BY f.query_id ORDER BY CASE WHEN b.boosted AND is_summary THEN 1 ELSE 0 END, rrf DESC, id) AS fused FROM best f JOIN boost b ON b.query_id = f.query_id WHERE rrf >= 0.4 * top),
pairs AS (SELECT *, row_number() OVER (PARTITION BY query_id, source, variable, is_summary ORDER BY score DESC, fused) AS p FROM fused),
quota AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, fused) AS s FROM pairs WHERE is_summary OR p <= 2),
chosen AS (SELECT query_id, id, score, source, variable, dataset, is_summary, fused, 0 AS step FROM quota WHERE s <= 3),
missing AS (SELECT f.*, row_number() OVER (PARTITION BY f.query_id, f.source ORDER BY score DESC, fused) AS r FROM fused f WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.query_id = f.query_id AND c.source = f.source)),
filler AS (SELECT m.*, row_number() OVER (PARTITION BY m.query_id ORDER BY score DESC, fused) + (SELECT count(DISTINCT c.source) FROM chosen c WHERE c.query_id = m.query_id) AS n FROM missing m WHERE r = 1),
filled AS (SELECT * FROM chosen UNION ALL SELECT query_id, id, score, source, variable, dataset, is_summary, fused, 1 FROM filler WHERE n <= 4),
every AS (SELECT query_id, id, arg_min(score, list_id * 1000 + rank) AS score, any_value(source) AS source, any_value(variable) AS variable, any_value(dataset) AS dataset, bool_or(is_summary) AS is_summary FROM lists GROUP BY 1, 2),
lacking AS (SELECT e.*, row_number() OVER (PARTITION BY e.query_id, e.source ORDER BY score DESC, id) AS r FROM every e WHERE NOT EXISTS (SELECT 1 FROM filled c WHERE c.query_id = e.query_id AND c.source = e.source)),
last AS (SELECT m.*, row_number() OVER (PARTITION BY m.query_id ORDER BY score DESC, id) + (SELECT count(DISTINCT c.source) FROM filled c WHERE c.query_id = m.query_id) AS n FROM lacking m WHERE r = 1),
whole AS (SELECT * FROM filled UNION ALL SELECT query_id, id, score, source, variable, dataset, is_summary, 0, 2 FROM last WHERE n <= 3)
SELECT query_id, id, score, source, variable, dataset, is_summary, CAST(row_number() OVER (PARTITION BY query_id ORDER BY step, score DESC, fused, id) AS INTEGER) AS place FROM whole"""


@register("search_ranking", SEARCH)
def search_ranking(spark, sf_dir):
    """A search's ranked lists fused, boosted, bounded by quotas and filled up, in order.

    A vector's neighbours by id stand for other wordings (the next one) and topics (the two after it, where its label is even).
    """
    points = _points(spark, sf_dir)
    asked = points.where("id % 50 = 0").select(F.col("id").alias("query_id"), "label", F.explode(F.array(*(F.struct(F.lit(n).alias("list_id"), F.lit(a).alias("ahead")) for n, a in ((0, 0), (2, 1), (100, 2), (101, 3))))).alias("l"))
    asked = asked.select("query_id", F.col("l.list_id").alias("list_id"), (F.col("query_id") + F.col("l.ahead")).alias("id"), (F.col("label") % 2 == 0).alias("several")).where("list_id < 100 or several")
    searches = asked.join(points.select("id", "embedding"), "id").withColumn("search", F.concat_ws(":", "query_id", "list_id"))
    hits = retrieve.knn(searches, points, 60, KEEP, query_id="search").withColumnRenamed("query_id", "search").join(searches.select("search", "query_id", "list_id", "several"), "search")
    lists = hits.where("list_id = 0 or rank <= 20").select("query_id", "list_id", "id", "score", "rank", F.concat(F.lit("s"), "label").alias("source"), F.concat(F.lit("v"), F.col("id") % 3).alias("variable"), F.concat(F.lit("d"), F.col("id") % 7).alias("dataset"), (F.col("id") % 11 == 0).alias("is_summary"), "several")
    grouped = retrieve.grouped_list(lists.where("list_id = 0")).withColumn("list_id", F.lit(1))
    weights = {0: 1.0, 1: 1.0, 2: 0.6, 100: 0.9, 101: 0.9}
    return retrieve.chosen_order(lists.unionByName(grouped), weights, F.col("several"))
