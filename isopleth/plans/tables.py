"""Registered queries of aggregation, joins, windows and mutations over the driver's tables."""

from pyspark.sql import functions as F

from isopleth.operators import collection, relate, summarize
from isopleth.plans.registry import register


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_chunks(spark, sf_dir):
    """events as chunks: one per event type and day."""
    return _read(spark, sf_dir, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value", "ts", "event_id", "user_id")


STATS = """round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.1), 6) AS p10,
 round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(max(v) - min(v), 6) AS range, CAST(count(*) AS BIGINT) AS n_cells"""
CHUNKS = f"""chunks AS (SELECT event_type AS variable, strftime(ts, '%Y-%m-%d') AS day, {STATS.replace('(v', '(value').replace('- min(v)', '- min(value)')} FROM events WHERE isfinite(value) GROUP BY 1, 2)"""


@register("chunk_stats8", f"WITH {CHUNKS} SELECT * FROM chunks")
def chunk_stats8(spark, sf_dir):
    """Eight statistics per chunk."""
    return summarize.chunk_stats8(_event_chunks(spark, sf_dir).withColumnRenamed("event_type", "variable"), ["variable", "day"], "value")


@register("dataset_summary", f"""WITH {CHUNKS} SELECT CASE WHEN variable IN ('click', 'view') THEN 'web' ELSE 'other' END AS dataset, string_agg(DISTINCT variable, ', ' ORDER BY variable) AS variables,
 min(day) AS time_start, max(day) AS time_end, round(avg(mean), 6) AS mean, min(min) AS min, max(max) AS max, CAST(count(*) AS BIGINT) AS n_chunks, TRUE AS is_dataset_summary FROM chunks GROUP BY 1""")
def dataset_summary(spark, sf_dir):
    """One summary per dataset."""
    chunks = chunk_stats8(spark, sf_dir).withColumns({"time_start": F.col("day"), "time_end": F.col("day"), "dataset": F.when(F.col("variable").isin("click", "view"), "web").otherwise("other")})
    return summarize.dataset_summary(chunks, "dataset")


@register("series_by_station", f"""WITH long AS (SELECT variable, station_col, station, v FROM (SELECT l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus FROM lineitem) t,
 LATERAL (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS variable, unnest([l_quantity, l_extendedprice, l_discount]) AS v) a,
 LATERAL (SELECT unnest(['l_returnflag', 'l_linestatus']) AS station_col, unnest([l_returnflag, l_linestatus]) AS station) b)
SELECT variable, station_col, station, {STATS} FROM long WHERE isfinite(v) GROUP BY 1, 2, 3""")
def series_by_station(spark, sf_dir):
    """Statistics per variable, station column and station; values are counted before they are copied per station."""
    rows = _read(spark, sf_dir, "lineitem")
    pairs = lambda columns: F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns)))
    rows = rows.select(pairs(["l_quantity", "l_extendedprice", "l_discount"]).alias("a"), "l_returnflag", "l_linestatus")
    rows = summarize.counted(rows.select(F.col("a.name").alias("variable"), "l_returnflag", "l_linestatus", F.col("a.value").alias("v")), "c").withColumn("b", pairs(["l_returnflag", "l_linestatus"]))
    rows = rows.select("variable", F.col("b.name").alias("station_col"), F.col("b.value").alias("station"), "v", "c")
    return summarize.group_stats8(rows, ["variable", "station_col", "station"], "v", "c")


@register("pressure_stats", f"""WITH cells AS (SELECT l_returnflag AS station, 101325 + l_discount / 10 + l_tax / 100 AS v FROM lineitem) SELECT station, {STATS} FROM cells WHERE isfinite(v) GROUP BY 1""")
def pressure_stats(spark, sf_dir):
    """Statistics of few large groups whose mean is far above their deviation."""
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("station"), (F.lit(101325) + F.col("l_discount") / 10 + F.col("l_tax") / 100).alias("v"))
    return summarize.group_stats8(rows, ["station"], "v")


@register("csv_block_chunks", f"""WITH numbered AS (SELECT event_id // 1000 AS block, value AS v FROM events) SELECT CAST(block AS BIGINT) AS block, {STATS} FROM numbered WHERE isfinite(v) GROUP BY 1""")
def csv_block_chunks(spark, sf_dir):
    """Statistics per block of a thousand event numbers, which stand for rows of a file here."""
    rows = _read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 1000).cast("long").alias("block"), F.col("value").alias("v"))
    return summarize.chunk_stats8(rows, ["block"], "v")


@register("slab_chunks", f"WITH s AS (SELECT user_id // 40 AS slab, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 90 AS BIGINT) AS span, value AS v FROM events) SELECT CAST(slab AS BIGINT) AS slab, span, {STATS} FROM s WHERE isfinite(v) GROUP BY 1, 2")
def slab_chunks(spark, sf_dir):
    """Slabs of 40 places by 90 time steps."""
    rows = _read(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 40).cast("long").alias("slab"), F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 90).cast("long").alias("span"), F.col("value").alias("v"))
    return summarize.chunk_stats8(rows, ["slab", "span"], "v")


@register("facet", "SELECT source AS value, CAST(count(*) AS BIGINT) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 15")
def facet(spark, sf_dir):
    """The most frequent sources."""
    return summarize.facet(_read(spark, sf_dir, "documents"), "source", 15)


@register("filtered_facet", "SELECT source, lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1, 2")
def filtered_facet(spark, sf_dir):
    """Languages within each source."""
    return summarize.filtered_facet(_read(spark, sf_dir, "documents"), "source", "lang")


@register("datasets_listing", """WITH c AS (SELECT source, lang, count(*) AS k FROM documents GROUP BY 1, 2), f AS (SELECT source, string_agg(lang || ':' || k, ',' ORDER BY k DESC, lang) AS variables FROM c GROUP BY 1)
SELECT source, CAST(count(*) AS BIGINT) AS n, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars, any_value(variables) AS variables FROM documents JOIN f USING (source) GROUP BY source""")
def datasets_listing(spark, sf_dir):
    """Counts, a sample row and variables of each dataset."""
    return summarize.datasets_listing(_read(spark, sf_dir, "documents"), "source", "lang", "doc_id", ["lang", "n_chars"])


@register("source_count", "SELECT CAST(count(*) AS BIGINT) AS n FROM documents WHERE source = 'src0'")
def source_count(spark, sf_dir):
    """Exact count of a source."""
    return _read(spark, sf_dir, "documents").where("source = 'src0'").agg(F.count("*").alias("n"))


@register("collection_stats", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT event_type) AS BIGINT) AS n_variables, CAST(count(DISTINCT user_id) AS BIGINT) AS n_sources, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS variables, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def collection_stats(spark, sf_dir):
    """Size, variables, sources and time range of the whole collection."""
    return _read(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("n_variables"), F.countDistinct("user_id").alias("n_sources"), summarize.joined("event_type").alias("variables"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@register("phase_status_counts", "SELECT o_orderpriority AS phase, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS n_f, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS n_o, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS n_p, CAST(count(*) AS BIGINT) AS total FROM orders GROUP BY 1")
def phase_status_counts(spark, sf_dir):
    """Statuses per phase."""
    return summarize.phase_status_counts(_read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "phase"), "phase", "o_orderstatus", ["F", "O", "P"])


@register("progress_rollup", """WITH p AS (SELECT o_custkey, o_orderkey % 4 AS phase, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status FROM orders)
SELECT o_custkey, CASE WHEN bool_or(phase > 0 AND status = 'completed') THEN 'processed' WHEN bool_or(phase > 0 AND status = 'failed') THEN 'failed' WHEN bool_or(phase = 0 AND status = 'completed') THEN 'metadata_only' ELSE 'pending' END AS state FROM p GROUP BY 1""")
def progress_rollup(spark, sf_dir):
    """One state per source."""
    rows = _read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 4).alias("phase"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending").alias("status"))
    return summarize.progress_rollup(rows, "o_custkey")


@register("source_grouping", """SELECT n_name, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS balance, round(greatest(max(c_acctbal), 0), 2) AS best
 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def source_grouping(spark, sf_dir):
    """A10: distinct lists, sums and maxima per group."""
    rows = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(summarize.joined("c_mktsegment").alias("segments"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.round(F.greatest(F.max("c_acctbal"), F.lit(0)), 2).alias("best"))


@register("distinct_values", """WITH long AS (SELECT 'lang' AS name, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents), d AS (SELECT DISTINCT name, value FROM long WHERE value IS NOT NULL)
SELECT name, CAST(count(*) AS BIGINT) AS n_values, CASE WHEN count(*) = 1 THEN min(value) WHEN count(*) <= 10 THEN string_agg(value, '|' ORDER BY value) END AS kept FROM d GROUP BY 1""")
def distinct_values(spark, sf_dir):
    """What a chunk keeps of its metadata columns."""
    return summarize.distinct_values(_read(spark, sf_dir, "documents"), ["lang", "source"])


@register("coordinate_extents", "SELECT event_type, min(user_id) AS low, max(user_id) AS high, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def coordinate_extents(spark, sf_dir):
    """Extents of each chunk's coordinates."""
    return _read(spark, sf_dir, "events").groupBy("event_type").agg(F.min("user_id").alias("low"), F.max("user_id").alias("high"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@register("catalog_counts", """WITH n AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1), t AS (SELECT c_mktsegment, count(*) AS n_segment FROM customer GROUP BY 1)
SELECT c_custkey, CAST(coalesce(n_orders, 0) AS BIGINT) AS n_orders, CAST(n_segment AS BIGINT) AS n_segment, coalesce(n_orders, 0) > 1 OR n_segment > 5 AS has_data FROM customer LEFT JOIN n ON o_custkey = c_custkey LEFT JOIN t USING (c_mktsegment)""")
def catalog_counts(spark, sf_dir):
    """Catalog rows with counts by source and by dataset."""
    customers = _read(spark, sf_dir, "customer")
    counts = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    totals = customers.groupBy("c_mktsegment").agg(F.count("*").alias("n_segment"))
    joined = customers.join(counts, "c_custkey", "left").join(totals, "c_mktsegment", "left")
    n = F.coalesce("n_orders", F.lit(0))
    return joined.select("c_custkey", n.alias("n_orders"), "n_segment", ((n > 1) | (F.col("n_segment") > 5)).alias("has_data"))


@register("latest_by_key", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def latest_by_key(spark, sf_dir):
    """Each customer's last order."""
    return relate.latest_by(_read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"])


@register("representative_row", "SELECT c_nationkey, arg_min(c_custkey, (c_acctbal < 0, c_custkey)) AS c_custkey FROM customer GROUP BY 1")
def representative_row(spark, sf_dir):
    """The first row that qualifies, else the first."""
    return _read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct(F.col("c_acctbal") < 0, "c_custkey")).alias("c_custkey"))


@register("resume_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def resume_anti(spark, sf_dir):
    """Entries without a completed row."""
    done = _read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return relate.pending(_read(spark, sf_dir, "customer"), done, "c_custkey").select("c_custkey", "c_name")


@register("already_full_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 10)")
def already_full_semi(spark, sf_dir):
    """Entries with ten chunks or more."""
    return relate.already_full(_read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", 10).select("c_custkey", "c_name")


@register("override_coalesce", """SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'own-' || s_suppkey END, r_name, s_name) AS target FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey % 2 = 0 LEFT JOIN region ON r_regionkey = n_regionkey""")
def override_coalesce(spark, sf_dir):
    """Prioritized lookups with a fallback."""
    suppliers = _read(spark, sf_dir, "supplier")
    own = suppliers.where("s_suppkey % 3 = 0").select("s_suppkey", F.concat(F.lit("own-"), "s_suppkey").alias("v"))
    regions = _read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").join(_read(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), "r_name")
    return relate.first_found(suppliers, [(own, "s_suppkey", "v"), (regions, "s_nationkey", "r_name")], F.col("s_name"), "target").select("s_suppkey", "target")


@register("sibling_fanout", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def sibling_fanout(spark, sf_dir):
    """One row per sibling of the same key."""
    customers, suppliers = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return relate.fan_out(customers, suppliers, "c_nationkey", "s_nationkey").select("c_custkey", "s_suppkey")


@register("duplicate_url", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS place FROM orders QUALIFY place > 1")
def duplicate_url(spark, sf_dir):
    """Rows whose key an earlier, smaller one already has."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"))
    return _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", place.alias("place")).where("place > 1")


@register("sync_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def sync_anti(spark, sf_dir):
    """Datasets that have no source row yet: customers without an urgent order."""
    return _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@register("cited_pairs", """WITH pairs AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_orderkey % 100 = 0) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE EXISTS (SELECT 1 FROM pairs WHERE a = l_partkey AND b = l_suppkey)""")
def cited_pairs(spark, sf_dir):
    """rows that match a cited pair."""
    rows = _read(spark, sf_dir, "lineitem")
    return relate.cited(rows, rows.where("l_orderkey % 100 = 0"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("year_overlap", """WITH c AS (SELECT o_custkey, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') END AS time_start, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') END AS time_end FROM orders GROUP BY 1)
SELECT * FROM c WHERE coalesce(nullif(left(time_start, 10), ''), '0000-01-01') <= '1994-12-31' AND coalesce(nullif(left(time_end, 10), ''), '9999-12-31') >= '1993-01-01'""")
def year_overlap(spark, sf_dir):
    """chunks whose time range meets a window of years."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    chunks = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    chunks = chunks.select("o_custkey", F.when(F.col("o_custkey") % 7 == 0, "").otherwise(text("a")).alias("time_start"), F.when(F.col("o_custkey") % 5 != 0, text("b")).alias("time_end"))
    return chunks.where(relate.year_overlap(F.col("time_start"), F.col("time_end"), 1993, 1994))


@register("forward_fill", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
def forward_fill(spark, sf_dir):
    """The last purchase up to each event of a user."""
    rows = _read(spark, sf_dir, "events").withColumn("p", F.when(F.col("event_type") == "purchase", F.col("value")))
    return relate.forward_fill(rows, "user_id", ["ts", "event_id"], "p", "last_purchase").select("event_id", "user_id", "last_purchase")


@register("sliding_failures", """WITH e AS (SELECT * FROM events WHERE event_type = 'error'), w AS (SELECT event_id, user_id, ts, count(*) OVER f AS n_recent, min(epoch_us(ts)) OVER f AS oldest FROM e WINDOW f AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, CAST(n_recent AS BIGINT) AS n_recent, n_recent >= 2 AS blocked, CASE WHEN n_recent >= 2 THEN CAST(ceil((oldest + 86400000000 - epoch_us(ts)) / 1000000.0) AS BIGINT) END AS retry_after FROM w""")
def sliding_failures(spark, sf_dir):
    """Failures of a user in a sliding day, and when the next attempt is due."""
    errors = _read(spark, sf_dir, "events").where("event_type = 'error'")
    return relate.sliding_count(errors, "user_id", "ts", 86400, 2).select("event_id", "user_id", "n_recent", "blocked", "retry_after")


@register("runs_latest", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def runs_latest(spark, sf_dir):
    """The last runs."""
    return _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)


@register("upsert_latest", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, sf_dir):
    """The last version of each key."""
    return collection.upsert_latest(_read(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@register("versioned_swap", "WITH r AS (SELECT *, event_id % 4 AS run FROM events), m AS (SELECT user_id, max(run) AS run FROM r GROUP BY 1) SELECT user_id, event_id, CAST(run AS BIGINT) AS run FROM r JOIN m USING (user_id, run)")
def versioned_swap(spark, sf_dir):
    """Rows of each source's last run."""
    return collection.versioned_swap(_read(spark, sf_dir, "events").withColumn("run", F.col("event_id") % 4), "user_id", "run").select("user_id", "event_id", "run")


@register("delete_by_source", "SELECT event_id, user_id FROM events WHERE NOT (event_type = 'view' AND (event_id % 4) <> 3)")
def delete_by_source(spark, sf_dir):
    """Without a source's rows of other runs."""
    return collection.delete_where(_read(spark, sf_dir, "events").withColumn("run", F.col("event_id") % 4), "event_type", "view", ("run", 3)).select("event_id", "user_id")


@register("update_by_filter", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'updated' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_by_filter(spark, sf_dir):
    """Some columns of a source's rows replaced."""
    rows = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return collection.update_where(rows, F.col("c_mktsegment") == "BUILDING", {"c_acctbal": F.lit(0.0), "c_mktsegment": F.lit("updated")})


FUZZY = """WITH n AS (SELECT DISTINCT p_name AS name FROM part), c AS (SELECT DISTINCT p_type AS entry FROM part), s AS (SELECT name, entry, list_distinct(string_split_regex(lower(trim(name)), '\\s+')) AS a, list_distinct(string_split(lower(entry), ' ')) AS b FROM n, c),
v AS (SELECT name, entry, CASE WHEN lower(trim(name)) = lower(entry) THEN 1.0 ELSE greatest(CAST(len(list_intersect(a, b)) AS DOUBLE) / greatest(len(a), len(b)), CASE WHEN contains(lower(entry), lower(trim(name))) OR contains(lower(trim(name)), lower(entry)) THEN 0.7 ELSE 0 END) END AS score FROM s)
SELECT name, entry AS match, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(score, 6) DESC, entry) AS r FROM v) WHERE r = 1 AND score >= 0.4"""


@register("fuzzy_match", FUZZY)
def fuzzy_match(spark, sf_dir):
    """The best match of each part's name among the part types."""
    parts = _read(spark, sf_dir, "part")
    return relate.best_fuzzy(parts.select("p_name").distinct(), parts.select("p_type"))


@register("fuzzy_match_indexed", FUZZY)
def fuzzy_match_indexed(spark, sf_dir):
    """The same by inverted lists of rare words and of character runs."""
    parts = _read(spark, sf_dir, "part")
    return relate.best_fuzzy_indexed(parts.select("p_name").distinct(), parts.select("p_type"))
