"""Registered queries of payloads, listings, bookkeeping and texts over the driver's tables, with SQL twins."""

from pyspark.sql import functions as F

from isopleth.functions import catalog, descriptions, scalars, texts
from isopleth.operators import bookkeeping, collection, listings, payload, relate, summarize
from isopleth.plans.registry import register
from isopleth.sources import delimited, logs, metadata
from isopleth.sources.scratch import folder


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(text):
    return "'" + text.replace("'", "''") + "'"


def _case(pairs, test, other="NULL"):
    return "CASE " + " ".join(f"WHEN {test(a)} THEN {_q(b)}" for a, b in pairs) + f" ELSE {other} END"


@register("payload_normalize", """WITH r AS (SELECT s_suppkey AS id, 's' || s_suppkey AS source_id, CASE s_suppkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN s_acctbal END AS a, CAST(s_nationkey AS DOUBLE) AS b, CASE s_suppkey % 2 WHEN 0 THEN '' ELSE 'K' END AS unit, 'mm' AS units,
 CASE s_suppkey % 4 WHEN 0 THEN '2020-01-01' END AS start_date, s_name AS note, s_acctbal AS m FROM supplier), n AS (SELECT *, CASE WHEN a IS NOT NULL AND a <> 0 THEN a ELSE b END AS latitude_min, CASE WHEN unit <> '' THEN unit ELSE units END AS u FROM r)
SELECT id, source_id, latitude_min, u AS unit, start_date AS time_start, m AS stats_mean, list_sort(list_filter(['dataset_name=' || source_id, 'note=' || note, 'source_id=' || source_id, 'time_start=' || start_date, 'unit=' || u, 'variable=unknown'], lambda x: x IS NOT NULL)) AS named FROM n""")
def payload_normalize(spark, sf_dir):
    """Name variants brought to one schema, extras kept, missing values left out."""
    n = F.col("s_suppkey")
    raw = _read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), n.cast("string")).alias("source_id"), F.when(n % 3 == 0, 0.0).when(n % 3 == 1, F.col("s_acctbal")).alias("lat_min"), F.col("s_nationkey").cast("double").alias("min_lat"),
        F.when(n % 2 == 0, "").otherwise("K").alias("unit"), F.lit("mm").alias("units"), F.when(n % 4 == 0, "2020-01-01").alias("start_date"), F.col("s_name").alias("note"), F.array_repeat("s_acctbal", 8).alias("stats"),
    )
    rows = payload.normalize(raw)
    named = F.filter(F.map_entries(payload.to_payload(rows)), lambda e: e["key"].isin("dataset_name", "note", "source_id", "time_start", "unit", "variable"))
    return rows.select(F.substring("source_id", 2, 20).cast("long").alias("id"), "source_id", "latitude_min", "unit", "time_start", "stats_mean", F.array_sort(F.transform(named, lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("named"))


@register("inject_context", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Drought' ELSE p_type END AS hazard_type, list_sort(CASE WHEN p_size % 3 = 0 THEN ['brand=own', 'tier=1'] ELSE ['brand=' || p_brand, 'tier=1'] END) AS extras FROM part")
def inject_context(spark, sf_dir):
    """Context laid over rows; custom entries only where the key is free."""
    three = F.col("p_size") % 3 == 0
    own = F.when(three, F.create_map(F.lit("brand"), F.lit("own"))).otherwise(F.create_map(F.lit("brand"), F.col("p_brand")))
    rows = _read(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_type").alias("hazard_type"), own.alias("extras"))
    rows = payload.inject_context(rows, {"hazard_type": F.when(F.col("p_size") % 2 == 0, "Drought")}, F.create_map(F.lit("brand"), F.lit("other"), F.lit("tier"), F.lit("1")))
    return rows.select("p_partkey", "hazard_type", F.array_sort(F.transform(F.map_entries("extras"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("extras"))


@register("flatten_chunk", "SELECT CAST(n_nationkey AS INTEGER) AS rank, n_nationkey / 10 AS score, CASE WHEN n_nationkey % 2 = 0 THEN 'm' || n_nationkey ELSE 'own' END AS source_id, n_name AS variable, '[' || n_regionkey || ',1]' AS shape FROM nation")
def flatten_chunk(spark, sf_dir):
    """Metadata of hits as columns."""
    n = F.col("n_nationkey")
    meta = F.struct(F.when(n % 2 == 0, F.concat(F.lit("m"), n.cast("string"))).otherwise("").alias("source_id"), F.array("n_regionkey", F.lit(1)).alias("shape"))
    hits = _read(spark, sf_dir, "nation").select(n.cast("int").alias("rank"), (n / 10).alias("score"), F.lit("own").alias("source_id"), F.col("n_name").alias("variable"), meta.alias("metadata"))
    return payload.flatten_chunk(hits)


@register("source_entries", "SELECT lower(replace(s_name, ' ', '_')) AS entry_id, s_name AS dataset_name, '' AS hazard, 'https://x/' || s_suppkey AS link, '' AS region_country, '' AS spatial_coverage, '' AS impact_sector, 'csv' AS data_type, CASE WHEN s_suppkey % 2 = 0 THEN '2001/' ELSE '' END AS temporal_coverage, 'a, ' || s_nationkey AS notes FROM supplier")
def source_entries(spark, sf_dir):
    """Sources as catalog entries."""
    n = F.col("s_suppkey")
    rows = _read(spark, sf_dir, "supplier").select(F.col("s_name").alias("source_id"), F.concat(F.lit("https://x/"), n.cast("string")).alias("url"), F.lit("csv").alias("format"), F.when(n % 2 == 0, "2001").alias("time_start"), F.lit(None).cast("string").alias("time_end"), F.array(F.lit("a"), F.col("s_nationkey").cast("string")).alias("variables"))
    return payload.source_as_entry(rows)


@register("chunk_ids", "SELECT l_orderkey, l_linenumber, 'o' || l_orderkey || CASE WHEN l_linenumber = 1 THEN '_summary' WHEN l_linenumber % 2 = 0 THEN '_chunk_' || l_linenumber ELSE '_portal_chunk_' || l_linenumber END AS id FROM lineitem")
def chunk_ids(spark, sf_dir):
    """Ids of chunks and summaries."""
    source, n = F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), F.col("l_linenumber")
    found = F.when(n == 1, payload.chunk_ids(source, n, "summary")).when(n % 2 == 0, payload.chunk_ids(source, n)).otherwise(payload.chunk_ids(source, n, "portal_chunk"))
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", found.alias("id"))


STATE = """e AS (SELECT s_suppkey, 's' || s_suppkey AS source_id, s_name AS dataset_name FROM supplier),
 st AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 's' || s_suppkey WHEN 1 THEN s_name ELSE 'job' || s_suppkey END AS key, CASE WHEN s_suppkey % 5 > 0 THEN s_name END AS dataset_name, s_suppkey % 7 AS done, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 6 END AS total, s_suppkey % 4 = 0 AS finished FROM supplier)"""


@register("entries_with_state", f"""WITH {STATE}, n AS (SELECT dataset_name, arg_min({{'done': done, 'total': total, 'finished': finished}}, key) AS s FROM st WHERE dataset_name IS NOT NULL GROUP BY 1),
 j AS (SELECT e.s_suppkey, coalesce(CASE WHEN a.key IS NOT NULL THEN {{'done': a.done, 'total': a.total, 'finished': a.finished}} END, CASE WHEN b.key IS NOT NULL THEN {{'done': b.done, 'total': b.total, 'finished': b.finished}} END, n.s) AS s FROM e LEFT JOIN st a ON a.key = e.source_id LEFT JOIN st b ON b.key = e.dataset_name LEFT JOIN n ON n.dataset_name = e.dataset_name)
SELECT s_suppkey, CASE WHEN s.total IS NOT NULL THEN s.done END AS done, s.total AS total, CASE WHEN s.total IS NOT NULL THEN s.done < s.total AND NOT s.finished END AS is_partial FROM j""")
def entries_with_state(spark, sf_dir):
    """The ingest state of catalog entries, by id, by name, by what a state names."""
    rows, n = _read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    entries = rows.select("s_suppkey", F.concat(F.lit("s"), n.cast("string")).alias("source_id"), F.col("s_name").alias("dataset_name"))
    key = F.when(n % 3 == 0, F.concat(F.lit("s"), n.cast("string"))).when(n % 3 == 1, F.col("s_name")).otherwise(F.concat(F.lit("job"), n.cast("string")))
    states = rows.select(key.alias("key"), F.when(n % 5 > 0, F.col("s_name")).alias("dataset_name"), (n % 7).alias("done"), F.when(n % 11 != 0, 6).alias("total"), (n % 4 == 0).alias("finished"))
    return listings.with_state(entries, states).select("s_suppkey", "done", "total", "is_partial")


LISTING = """c AS (SELECT p_partkey AS row_index, 'p' || p_partkey AS source_id, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_brand || (p_partkey % 40) END AS dataset_name, CASE p_size % 4 WHEN 0 THEN 'Drought' WHEN 1 THEN 'Flood' WHEN 2 THEN '' END AS hazard, CASE p_size % 3 WHEN 0 THEN 'Europe' END AS region_country, CASE WHEN p_partkey % 2 = 0 THEN 'https://d/' || p_partkey ELSE 'ask' END AS link FROM part),
 db AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'p' || s_suppkey WHEN 1 THEN 'catalog_' || s_suppkey ELSE 'user' || s_suppkey END AS source_id, s_name AS dataset_name, CASE WHEN s_suppkey % 2 = 0 THEN 'https://u/' || s_suppkey ELSE '' END AS url, CASE s_suppkey % 4 WHEN 0 THEN 'failed' END AS status, 'Heat' AS hazard_type FROM supplier),
 n AS (SELECT 'p' || l_partkey AS source_id, max(p_brand || (p_partkey % 40)) AS dataset_name, count(*) AS chunks FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 4 < 2 GROUP BY 1),
 e AS (SELECT c.*, coalesce(nullif(c.dataset_name, ''), c.source_id) AS ds, coalesce(n.chunks, 0) AS own, db.source_id AS dbid, db.url AS dburl, db.status AS dbstatus FROM c LEFT JOIN n USING (source_id) LEFT JOIN db USING (source_id)),
 t AS (SELECT dataset_name, sum(chunks) AS in_dataset FROM n GROUP BY 1),
 g AS (SELECT ds, arg_min({'id': source_id, 'link': link, 'own': own}, CASE WHEN link LIKE 'http%' THEN 0 ELSE 1000000000 END + row_index) AS rep, arg_min({'id': dbid, 'url': dburl, 'status': dbstatus, 'own': own}, row_index) FILTER (WHERE dbid IS NOT NULL) AS db,
  string_agg(DISTINCT nullif(hazard, ''), ', ' ORDER BY nullif(hazard, '')) AS hazard, string_agg(DISTINCT region_country, ', ' ORDER BY region_country) AS region_country, sum(own) AS group_chunks, count(*) AS catalog_rows FROM e GROUP BY 1),
 k AS (SELECT coalesce(db.id, rep.id) AS source_id, ds AS dataset_name, coalesce(nullif(db.url, ''), rep.link, '') AS url, CASE WHEN db.id IS NOT NULL THEN db.own ELSE rep.own END AS ch, coalesce(in_dataset, 0) AS ind, db.status AS st, group_chunks, coalesce(hazard, CASE WHEN db.id IS NOT NULL THEN 'Heat' END) AS hazard_type, region_country, catalog_rows FROM g LEFT JOIN t ON t.dataset_name = g.ds),
 u AS (SELECT db.source_id, db.dataset_name, db.url, coalesce(n.chunks, 0) AS ch, coalesce(t.in_dataset, 0) AS ind, db.status AS st, 0 AS group_chunks, db.hazard_type, CAST(NULL AS VARCHAR) AS region_country, 0 AS catalog_rows FROM db LEFT JOIN n USING (source_id) LEFT JOIN t ON t.dataset_name = db.dataset_name WHERE NOT starts_with(db.source_id, 'catalog_') AND db.source_id NOT IN (SELECT source_id FROM k)),
 every AS (SELECT *, TRUE AS from_catalog FROM k UNION ALL SELECT *, FALSE FROM u),
 listed AS (SELECT source_id, dataset_name, url, CASE WHEN ch > 1 OR ind > 5 THEN 'completed' WHEN ch > 0 THEN 'metadata_only' ELSE coalesce(st, 'pending') END AS status, CAST(greatest(group_chunks, ch) AS BIGINT) AS chunks, hazard_type, region_country, CAST(catalog_rows AS BIGINT) AS catalog_rows, from_catalog FROM every)"""


def _listing(spark, sf_dir):
    part, supplier = _read(spark, sf_dir, "part"), _read(spark, sf_dir, "supplier")
    n, s, key, size = F.col("p_partkey"), F.col("s_suppkey"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.col("p_size")
    name = F.concat("p_brand", (n % 40).cast("string"))
    catalog = part.select(
        n.alias("row_index"), key.alias("source_id"), F.when(n % 9 == 0, "").otherwise(name).alias("dataset_name"), F.when(size % 4 == 0, "Drought").when(size % 4 == 1, "Flood").when(size % 4 == 2, "").alias("hazard"),
        F.when(size % 3 == 0, "Europe").alias("region_country"), F.lit(None).cast("string").alias("impact_sector"), F.when(n % 2 == 0, F.concat(F.lit("https://d/"), n.cast("string"))).otherwise("ask").alias("link"),
    )
    text = s.cast("string")
    stored = supplier.select(
        F.when(s % 3 == 0, F.concat(F.lit("p"), text)).when(s % 3 == 1, F.concat(F.lit("catalog_"), text)).otherwise(F.concat(F.lit("user"), text)).alias("source_id"), F.col("s_name").alias("dataset_name"),
        F.when(s % 2 == 0, F.concat(F.lit("https://u/"), text)).otherwise("").alias("url"), F.when(s % 4 == 0, "failed").alias("status"), F.lit("Heat").alias("hazard_type"),
    )
    lines = _read(spark, sf_dir, "lineitem").where("l_partkey % 4 < 2").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("chunks"))
    counts = lines.join(part, "p_partkey").select(key.alias("source_id"), name.alias("dataset_name"), "chunks")
    return listings.sources_listing(catalog, stored, counts).drop("impact_sector")


@register("sources_listing", f"WITH {LISTING} SELECT * FROM listed")
def sources_listing(spark, sf_dir):
    """One row per dataset of the catalog and per stored source of a user."""
    return _listing(spark, sf_dir)


@register("listing_filters", f"WITH {LISTING} SELECT source_id, dataset_name, chunks FROM listed WHERE contains(lower(dataset_name), 'brand#1') AND chunks > 10 AND contains(coalesce(hazard_type, ''), 'Flood') AND contains(coalesce(region_country, ''), 'Europe') AND from_catalog")
def listing_filters(spark, sf_dir):
    """F16: a listing by text, state, hazard, place and origin."""
    return listings.filtered(_listing(spark, sf_dir), "BRAND#1", "completed", "Flood", "Europe", "catalog").select("source_id", "dataset_name", "chunks")


@register("hazard_counts", f"WITH {LISTING} SELECT value, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(string_split(hazard_type, ','), lambda x: trim(x)))) AS value FROM listed WHERE hazard_type IS NOT NULL) GROUP BY 1")
def hazard_counts(spark, sf_dir):
    """Rows per value of a comma-joined column."""
    return listings.split_counts(_listing(spark, sf_dir), "hazard_type")


@register("dashboard_totals", f"WITH {LISTING} SELECT count(*) FILTER (WHERE NOT (chunks <= 10 OR NOT from_catalog)) AS with_data, count(*) FILTER (WHERE chunks <= 10 OR NOT from_catalog) AS metadata_only FROM listed")
def dashboard_totals(spark, sf_dir):
    """Datasets with and without data."""
    return listings.dashboard(_listing(spark, sf_dir).withColumn("bare", ~F.col("from_catalog")), "chunks", "hazard_type", "region_country", "bare")["totals"]


@register("dashboard_places", f"WITH {LISTING} SELECT coalesce(region_country, 'Unknown') AS value, count(*) AS n FROM listed GROUP BY 1")
def dashboard_places(spark, sf_dir):
    """Datasets per place."""
    return listings.dashboard(_listing(spark, sf_dir).withColumn("bare", ~F.col("from_catalog")), "chunks", "hazard_type", "region_country", "bare")["places"]


@register("sample_health", "WITH s AS (SELECT * FROM events ORDER BY event_id LIMIT 1000) SELECT 'dataset_name' AS kind, event_type AS value, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'variable', 'u' || (user_id % 7), count(*) FROM s GROUP BY 2")
def sample_health(spark, sf_dir):
    """What the first points of a collection are of."""
    points = _read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("dataset_name"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("variable"))
    return listings.sample_health(points, "event_id")


@register("count_delta", "SELECT c AS o_custkey, n_before, n_after, n_after - n_before AS added, n_after > n_before AS success FROM (SELECT o_custkey AS c, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_before, count(*) FILTER (WHERE o_orderstatus <> 'P') AS n_after FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)")
def count_delta(spark, sf_dir):
    """Counts before and after a run."""
    orders = _read(spark, sf_dir, "orders")
    return listings.count_delta(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'P'"), "o_custkey")


@register("url_repeats", "SELECT a.page_id FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN ' ' || upper(url) || '// ' ELSE url || 'x' END AS url, page_id % 10 AS ds FROM pages) a WHERE EXISTS (SELECT 1 FROM pages p WHERE p.page_id % 10 = a.ds AND lower(rtrim(trim(p.url), '/')) = lower(rtrim(trim(a.url), '/')))")
def url_repeats(spark, sf_dir):
    """New rows whose dataset has their URL already."""
    pages = _read(spark, sf_dir, "pages").withColumn("dataset_name", F.col("page_id") % 10)
    new = pages.withColumn("url", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), F.upper("url"), F.lit("// "))).otherwise(F.concat("url", F.lit("x"))))
    return listings.repeats_url(new, pages).select("page_id")


TRUTH = [("a", {"variable": ["src3", "src5"], "temporal": ["was"]}), ("b", {"hazard": ["with"], "spatial": ["fr", "und"], "temporal": ["that"]}), ("c", {"temporal": ["that"]}), ("d", {"source": ["der"]})]


def _any(column, parts):
    return "(" + " OR ".join(f"contains({column}, {_q(p)})" for p in parts) + ")"


@register("pattern_truth", f"""WITH d AS (SELECT doc_id AS id, lower(coalesce(text, '')) AS t, lower(coalesce(source, '')) AS s, lower(coalesce(lang, '')) AS v FROM documents),
 s AS (SELECT 'a' AS query, id, 2 * CAST({_any('s', ['src3', 'src5'])} AS INTEGER) + CAST({_any('t', ['src3', 'src5'])} AS INTEGER) + CAST({_any('t', ['was'])} AS INTEGER) AS score FROM d
 UNION ALL SELECT 'b', id, 2 * CAST({_any('t', ['with'])} AS INTEGER) + 2 * CAST({_any('t', ['fr', 'und'])} OR {_any('v', ['fr', 'und'])} AS INTEGER) + CAST({_any('t', ['that'])} AS INTEGER) FROM d
 UNION ALL SELECT 'd', id, 2 * CAST({_any('t', ['der'])} OR {_any('v', ['der'])} AS INTEGER) FROM d)
SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY id) AS r FROM s WHERE score >= 2) WHERE r <= 10""")
def pattern_truth(spark, sf_dir):
    """The first documents that a query's patterns fit."""
    points = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("variable"), F.col("lang").alias("dataset_name"))
    return listings.pattern_truth(points, TRUTH)


@register("enriched_variables", """WITH e AS (SELECT DISTINCT p_brand AS variable, 'long ' || lower(p_brand) AS long_name, CASE WHEN p_brand < 'Brand#3' THEN 'about ' || p_brand END AS description FROM part WHERE p_brand < 'Brand#4')
SELECT p_partkey, p_brand AS variable, coalesce(long_name, p_name) AS long_name, description AS variable_description FROM part LEFT JOIN e ON e.variable = p_brand""")
def enriched_variables(spark, sf_dir):
    """J19, X18, UD7: lines of an enricher read and joined to variables."""
    part = _read(spark, sf_dir, "part")
    about = F.when(F.col("p_brand") < "Brand#3", F.concat(F.lit(" | DESCRIPTION: about "), "p_brand")).otherwise("")
    line = F.when(F.col("p_brand") < "Brand#4", F.concat(F.lit("VARIABLE: "), "p_brand", F.lit(" | LONG_NAME: long "), F.lower("p_brand"), about)).otherwise(F.concat(F.lit("VARIABLE: "), "p_brand"))
    table = descriptions.enrichments(part.select(line.alias("line"), F.col("p_partkey").alias("n")))
    return descriptions.enriched(part.select("p_partkey", F.col("p_brand").alias("variable"), F.col("p_name").alias("long_name")), table)


def _title(text):
    return f"array_to_string(list_transform(string_split({text}, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"


D2 = "CAST(CAST(round({}, 2) AS DECIMAL(18, 2)) AS VARCHAR)"
DESCRIBED = f"""SELECT c_custkey, concat_ws(' | ', 'Climate variable: ' || {_case(list(descriptions.VARIABLE_NAMES.items())[:3], lambda a: f"v = {_q(a)}", _title("replace(v, '_', ' ')"))} || ' (' || v || ')', CASE WHEN src <> 'unknown' THEN 'Dataset: ' || src END, 'Time: ' || t, CASE WHEN starts_with(t, '2') THEN 'Date: ' || strftime(CAST(left(t, 10) AS DATE), '%B %Y') END,
 'Latitude: ' || {D2.format('lo')} || '° to ' || {D2.format('hi')} || '°', 'Longitude: ' || {D2.format('lo * 2')} || '° to ' || {D2.format('hi * 2')} || '°', {{stats}}) AS text
 FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 't2m' WHEN 1 THEN '2m_temperature' ELSE lower(c_mktsegment) || '_index' END AS v, CASE c_custkey % 3 WHEN 0 THEN 'unknown' ELSE 'D' || c_nationkey END AS src, CASE c_custkey % 2 WHEN 0 THEN '2020-0' || (1 + c_custkey % 9) || '-05T00:00' ELSE 'spring' END AS t, CAST(c_nationkey AS DOUBLE) AS lo, c_nationkey + 0.5 AS hi, c_acctbal AS m FROM customer)"""
STATS_LOW = f"'Mean: ' || {D2.format('m')} || ' K', 'Range: ' || {D2.format('m + 2')} || ' to ' || {D2.format('m + 3')} || ' K'"
STATS_HIGH = ", ".join(f"'{label}: ' || {D2.format(f'm + {i}')} || ' K'" for label, i in (("Mean", 0), ("Standard deviation", 1), ("Minimum", 2), ("Maximum", 3), ("Median", 5), ("10th percentile", 4), ("90th percentile", 6), ("Range", 7)))


def _described(spark, sf_dir, verbosity):
    n = F.col("c_custkey")
    variable = F.when(n % 4 == 0, "t2m").when(n % 4 == 1, "2m_temperature").otherwise(F.concat(F.lower("c_mktsegment"), F.lit("_index")))
    source = F.when(n % 3 == 0, "unknown").otherwise(F.concat(F.lit("D"), F.col("c_nationkey").cast("string")))
    time = F.when(n % 2 == 0, F.concat(F.lit("2020-0"), (1 + n % 9).cast("string"), F.lit("-05T00:00"))).otherwise("spring")
    low, high = F.col("c_nationkey").cast("double"), F.col("c_nationkey") + 0.5
    stats = F.array(*(F.col("c_acctbal") + i for i in range(8)))
    return _read(spark, sf_dir, "customer").select("c_custkey", descriptions.describe(variable, source, time, (low, high, low * 2, high * 2), stats, F.lit("K"), verbosity).alias("text"))


@register("describe_low", DESCRIBED.format(stats=STATS_LOW))
def describe_low(spark, sf_dir):
    """Short descriptions of chunks."""
    return _described(spark, sf_dir, "low")


@register("describe_high", DESCRIBED.format(stats=STATS_HIGH))
def describe_high(spark, sf_dir):
    """Full descriptions of chunks."""
    return _described(spark, sf_dir, "high")


@register("catalog_texts", """WITH e AS (SELECT p_partkey, p_name, CASE p_size % 3 WHEN 0 THEN '' ELSE p_type END AS hazard, CASE p_size % 4 WHEN 0 THEN 'Global' WHEN 1 THEN 'regional' WHEN 2 THEN NULL ELSE 'Balkans ' END AS cov, CASE WHEN p_size % 5 = 0 THEN '1 km' END AS res, CASE WHEN p_partkey % 2 = 0 THEN '1990-2020' END AS per, CASE WHEN p_partkey % 3 = 0 THEN 'daily' END AS tres, CASE WHEN p_partkey % 7 = 0 THEN ' Greece ' END AS reg, CASE WHEN p_partkey % 5 = 0 THEN 'YES' ELSE 'no' END AS bias FROM part),
 l AS (SELECT *, CASE WHEN reg <> '' THEN trim(reg) WHEN lower(trim(cov)) = 'global' THEN 'Global' WHEN lower(trim(cov)) = 'regional' THEN 'Regional' WHEN cov <> '' THEN trim(cov) ELSE 'Unknown' END AS loc FROM e)
SELECT p_partkey, loc AS location, concat_ws('. ', 'Climate dataset: ' || p_name, CASE WHEN hazard <> '' THEN 'Hazard: ' || hazard END, CASE WHEN cov IS NOT NULL OR res IS NOT NULL THEN 'Coverage: ' || concat_ws(' ', cov, 'at ' || res) END, CASE WHEN per IS NOT NULL OR tres IS NOT NULL THEN 'Period: ' || concat_ws(', ', per, tres) END,
 CASE WHEN loc <> 'Unknown' THEN 'Region: ' || loc END, CASE WHEN bias = 'YES' THEN 'Bias-corrected version available' END) || '.' AS text FROM l""")
def catalog_texts(spark, sf_dir):
    """Descriptions and places of catalog entries."""
    n, size = F.col("p_partkey"), F.col("p_size")
    entry = {
        "dataset_name": F.col("p_name"), "hazard": F.when(size % 3 == 0, "").otherwise(F.col("p_type")), "spatial_coverage": F.when(size % 4 == 0, "Global").when(size % 4 == 1, "regional").when(size % 4 == 3, "Balkans "),
        "spatial_resolution": F.when(size % 5 == 0, "1 km"), "temporal_coverage": F.when(n % 2 == 0, "1990-2020"), "temporal_resolution": F.when(n % 3 == 0, "daily"),
        "region_country": F.when(n % 7 == 0, " Greece "), "bias_corrected": F.when(n % 5 == 0, "YES").otherwise("no"),
    }
    place = descriptions.location(entry["region_country"], entry["spatial_coverage"], F.lit("x"))
    return _read(spark, sf_dir, "part").select("p_partkey", place.alias("location"), descriptions.catalog_text(entry | {"dataset_name": F.col("p_name")}).alias("text"))


@register("topic_queries", f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN [{_q(descriptions.TOPIC_QUERIES['drought'])}, 'ash climate data'] ELSE [] END AS found FROM conversations")
def topic_queries(spark, sf_dir):
    """A search text per topic where there are several."""
    found = F.when(F.col("turn") % 2 == 0, F.array(F.lit("drought"), F.lit("ash"))).otherwise(F.array(F.lit("drought")))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", descriptions.topic_queries(found).alias("found"))


@register("content_type_format", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'netcdf' WHEN 2 THEN 'gz' END AS format FROM pages")
def content_type_format(spark, sf_dir):
    """Formats by content type, then by the end of the path."""
    n = F.col("page_id") % 4
    kind = F.when(n == 0, " Text/CSV; charset=utf-8").when(n == 1, "application/octet-stream").when(n == 3, "text/html")
    path = F.when(n == 0, "/a.nc").when(n == 1, "/A.NC").when(n == 2, "/b.tar.gz").otherwise("/c")
    return _read(spark, sf_dir, "pages").select("page_id", descriptions.format_of(kind, path).alias("format"))


NOW = "2024-02-10 12:00:00"


def _sources(spark, sf_dir):
    """The last event of each user stands for a source's row."""
    events = _read(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts", "event_type", "value"), "event_id").alias("e")).select("user_id", "e.*")
    n = F.col("user_id")
    status = F.when(n % 3 == 0, "processing").when(n % 3 == 1, "completed").otherwise("pending")
    return last.select(n.cast("string").alias("source_id"), status.alias("processing_status"), F.when(n % 5 == 0, "old").alias("error_message"), F.col("ts").alias("updated_at"), (F.col("ts") - F.expr("INTERVAL 20 DAYS")).alias("last_processed_at"), (n % 4 != 0).alias("is_active"), F.array(F.col("event_type"), F.lit("all")).alias("tags"))


SOURCES = """src AS (SELECT CAST(user_id AS VARCHAR) AS source_id, user_id AS n, CASE user_id % 3 WHEN 0 THEN 'processing' WHEN 1 THEN 'completed' ELSE 'pending' END AS processing_status, CASE WHEN user_id % 5 = 0 THEN 'old' END AS error_message, ts AS updated_at, ts - INTERVAL 20 DAY AS last_processed_at, user_id % 4 <> 0 AS is_active, event_type FROM events WHERE event_id IN (SELECT max(event_id) FROM events GROUP BY user_id))"""


@register("stale_sources", f"WITH {SOURCES} SELECT source_id, processing_status = 'processing' AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE AS orphan, processing_status = 'completed' AND last_processed_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS stale, updated_at < TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE AS stalled FROM src")
def stale_sources(spark, sf_dir):
    """F11, ST2, ST6: which sources are orphans, stale, or silent at a time."""
    now, status = F.lit(NOW).cast("timestamp"), F.col("processing_status")
    return _sources(spark, sf_dir).select("source_id", bookkeeping.is_orphan(status, F.col("updated_at"), now).alias("orphan"), bookkeeping.is_stale(status, F.col("last_processed_at"), now).alias("stale"), bookkeeping.is_stalled(F.col("updated_at"), now).alias("stalled"))


@register("reset_orphans", f"WITH {SOURCES} SELECT source_id, CASE WHEN o THEN 'failed' ELSE processing_status END AS processing_status, CASE WHEN o THEN 'Processing interrupted: no progress for more than 30 minutes' ELSE error_message END AS error_message FROM (SELECT *, processing_status = 'processing' AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE AS o FROM src)")
def reset_orphans(spark, sf_dir):
    """Sources in work without progress become failed."""
    return bookkeeping.reset_orphans(_sources(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("source_id", "processing_status", "error_message")


@register("status_updates", f"""WITH {SOURCES} SELECT source_id, CASE n % 6 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE processing_status END AS processing_status, CASE n % 6 WHEN 0 THEN NULL WHEN 1 THEN 'bad' ELSE error_message END AS error_message,
 CASE n % 6 WHEN 0 THEN TIMESTAMP '{NOW}' ELSE last_processed_at END AS last_processed_at FROM src""")
def status_updates(spark, sf_dir):
    """New states; a completed source loses its error."""
    sources = _sources(spark, sf_dir)
    n = F.col("source_id").cast("long") % 6
    changes = sources.where(n < 2).select("source_id", F.when(n == 0, "completed").otherwise("failed").alias("status"), F.when(n == 1, "bad").otherwise("").alias("error"))
    return bookkeeping.set_status(sources, changes, F.lit(NOW).cast("timestamp")).select("source_id", "processing_status", "error_message", "last_processed_at")


@register("source_changes", f"""WITH {SOURCES}, changed AS (SELECT source_id, n, CASE WHEN n % 7 = 0 THEN 'edited' ELSE error_message END AS error_message, is_active AND n % 5 <> 1 AS is_active FROM src WHERE n % 11 <> 0)
SELECT source_id, error_message, is_active FROM changed UNION ALL SELECT 'new' || n, NULL, TRUE FROM src WHERE n % 20 = 0""")
def source_changes(spark, sf_dir):
    """Sources created, updated, set inactive and deleted."""
    now, sources = F.lit(NOW).cast("timestamp"), _sources(spark, sf_dir).withColumn("created_at", F.lit(None).cast("timestamp"))
    n = F.col("source_id").cast("long")
    table = bookkeeping.update(sources, sources.where(n % 7 == 0).select("source_id", F.lit("edited").alias("error_message"), F.lit(1).alias("unknown")), "source_id", now)
    table = bookkeeping.soft_delete(table, sources.where(n % 5 == 1), now)
    table = bookkeeping.hard_delete({"sources": table}, sources.where(n % 11 == 0))["sources"]
    new = sources.where(n % 20 == 0).select(F.concat(F.lit("new"), "source_id").alias("source_id"), F.lit(True).alias("is_active"))
    return bookkeeping.create(table, new, "source_id", now).select("source_id", "error_message", "is_active")


@register("tagged_sources", f"WITH {SOURCES} SELECT source_id FROM src WHERE is_active AND event_type IN ('click', 'error')")
def tagged_sources(spark, sf_dir):
    """active sources that have any of some tags."""
    return bookkeeping.with_tags(_sources(spark, sf_dir), ["click", "error"]).select("source_id")


@register("due_sources", f"WITH {SOURCES} SELECT source_id FROM src WHERE is_active AND n % 3 <> 0 AND updated_at <= TIMESTAMP '{NOW}'")
def due_sources(spark, sf_dir):
    """Active sources whose enabled schedule is due."""
    sources = _sources(spark, sf_dir)
    schedules = sources.select("source_id", (F.col("source_id").cast("long") % 3 != 0).alias("is_enabled"), F.col("updated_at").alias("next_run_at"))
    return bookkeeping.due_sources(sources, schedules, F.lit(NOW).cast("timestamp")).select("source_id")


@register("schedule_poll", f"WITH {SOURCES} SELECT source_id, CASE WHEN n % 3 <> 0 AND updated_at <= TIMESTAMP '{NOW}' THEN CASE WHEN n % 2 = 0 THEN TIMESTAMP '2024-02-10 12:30:00' ELSE TIMESTAMP '2024-02-12 00:00:00' END ELSE updated_at END AS next_run_at FROM src")
def schedule_poll(spark, sf_dir):
    """ST1, C05: schedules advanced to their next run."""
    n = F.col("source_id").cast("long")
    schedules = _sources(spark, sf_dir).select("source_id", (n % 3 != 0).alias("is_enabled"), F.col("updated_at").alias("next_run_at"), F.when(n % 2 == 0, "30 */6 * * *").otherwise("0 0 * * 1").alias("cron_expression"))
    none = spark.createDataFrame([], "run_key string")
    return bookkeeping.poll(schedules, none, F.lit(NOW).cast("timestamp"))[1].select("source_id", "next_run_at")


@register("run_history", """WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'started' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN date_diff('second', o_orderdate, TIMESTAMP '2030-01-01') * 1.0 END AS seconds FROM orders)
SELECT o_orderkey AS run_id, CAST(o_custkey AS VARCHAR) AS source_id, status, seconds AS duration_seconds, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS place FROM r) WHERE place <= 5""")
def run_history(spark, sf_dir):
    """Runs completed, and the last of each source."""
    orders = _read(spark, sf_dir, "orders")
    runs = orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").cast("string").alias("source_id"), F.lit("started").alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("double").alias("duration_seconds"), F.lit(None).cast("long").alias("chunks_processed"), F.lit(None).cast("string").alias("error_message"))
    ends = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("run_id"), F.lit("completed").alias("status"), F.lit(1).cast("long").alias("chunks"), F.lit(None).cast("string").alias("error"))
    done = bookkeeping.complete_runs(runs, ends, F.lit("2030-01-01 00:00:00").cast("timestamp"))
    return bookkeeping.history(done, 5).select("run_id", "source_id", "status", "duration_seconds", "place")


@register("credentials", "SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % 50 END AS source_id, 'k' || c_custkey AS credential_key, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS credential_value FROM customer UNION ALL SELECT NULL, 'extra', 'x'")
def credentials(spark, sf_dir):
    """Credentials set by source and key, where no source is a source too."""
    n = F.col("c_custkey")
    table = _read(spark, sf_dir, "customer").select(F.when(n % 10 != 0, n % 50).alias("source_id"), F.concat(F.lit("k"), n.cast("string")).alias("credential_key"), F.col("c_name").alias("credential_value"))
    changes = table.where(F.substring("credential_key", 2, 20).cast("long") % 3 == 0).withColumn("credential_value", F.lit("new"))
    changes = changes.union(spark.createDataFrame([(None, "extra", "x")], changes.schema))
    return bookkeeping.set_keyed(table, changes, ["source_id", "credential_key"])


@register("migrated_rows", "SELECT count(*) AS n, count(*) FILTER (WHERE c_nationkey < 5) AS low FROM customer")
def migrated_rows(spark, sf_dir):
    """An older store's rows moved over once."""
    rows = _read(spark, sf_dir, "customer")
    table = rows.where("c_nationkey < 5")
    both = table.union(bookkeeping.new_rows(table, rows, "c_custkey"))
    again = both.union(bookkeeping.new_rows(both, rows, "c_custkey"))
    return again.agg(F.count("*").alias("n"), F.count_if(F.col("c_nationkey") < 5).alias("low"))


@register("progress_upsert", "SELECT user_id, phase, CASE WHEN event_id % 2 = 0 THEN 'completed' ELSE 'failed' END AS status FROM (SELECT user_id, event_id % 5 AS phase, max(event_id) AS event_id FROM events GROUP BY 1, 2)")
def progress_upsert(spark, sf_dir):
    """States of sources and phases, written one over the other."""
    rows = _read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 5).alias("phase"), "event_id", F.when(F.col("event_id") % 2 == 0, "completed").otherwise("failed").alias("status"))
    return collection.upsert_latest(rows, ["user_id", "phase"], ["event_id"]).select("user_id", "phase", "status")


@register("orders_of_lists", """SELECT 'created' AS kind, CAST(o_orderkey AS VARCHAR) AS item, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE epoch(o_orderdate) END DESC, o_orderkey) AS place FROM orders
UNION ALL SELECT 'size', CAST(p_partkey AS VARCHAR), row_number() OVER (ORDER BY CASE WHEN p_size % 5 = 0 THEN 10737418240 ELSE p_size END, p_partkey) FROM part UNION ALL SELECT 'name', s_name, row_number() OVER (ORDER BY lower(s_name) DESC) FROM supplier
UNION ALL SELECT 'clamped', CAST(n_nationkey AS VARCHAR), greatest(1, least(n_nationkey * 2, 20)) FROM nation""")
def orders_of_lists(spark, sf_dir):
    """Lists in their orders; the place that each item has."""
    def places(rows, kind, item, *order):
        listed = rows.select(F.lit(kind).alias("kind"), item.cast("string").alias("item"), *(o.alias(f"_{i}") for i, (o, _) in enumerate(order)))
        by = [F.desc(f"_{i}") if down else F.asc(f"_{i}") for i, (_, down) in enumerate(order)]
        return relate.numbered(listed, "kind", by, "place").select("kind", "item", (F.col("place") + 1).alias("place"))

    orders, part, supplier, nation = (_read(spark, sf_dir, name) for name in ("orders", "part", "supplier", "nation"))
    created = F.when(F.col("o_orderkey") % 4 != 0, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
    size = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("long"))
    found = places(orders, "created", F.col("o_orderkey"), (F.coalesce(created, F.lit(0)), True), (F.col("o_orderkey"), False))
    found = found.union(places(part, "size", F.col("p_partkey"), (F.coalesce(size, F.lit(listings.UNKNOWN_SIZE)), False), (F.col("p_partkey"), False)))
    found = found.union(places(supplier, "name", F.col("s_name"), (F.lower("s_name"), True)))
    return found.union(nation.select(F.lit("clamped"), F.col("n_nationkey").cast("string"), listings.clamped(F.col("n_nationkey") * 2).cast("long")))


@register("variable_names", "SELECT DISTINCT event_type AS variable FROM events UNION SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL")
def variable_names(spark, sf_dir):
    """Distinct variables in order."""
    both = _read(spark, sf_dir, "events").select(F.col("event_type").alias("variable")).union(_read(spark, sf_dir, "documents").select("lang"))
    return both.where("variable is not null").distinct().orderBy("variable")


@register("log_tail", """WITH e AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'Traceback ' || event_id ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || ' ' || event_type END AS line, CASE event_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS label FROM events),
 l AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY event_id DESC) AS r, CASE WHEN starts_with(line, 'T') THEN '~' ELSE replace(left(line, 23), ',', '.') END AS stamp FROM e), t AS (SELECT * FROM l WHERE r <= 200 ORDER BY stamp DESC, label DESC, r LIMIT 200)
SELECT CAST(row_number() OVER (ORDER BY stamp, label, r DESC) AS INTEGER) AS place, label, stamp, line FROM t""")
def log_tail(spark, sf_dir):
    """The merged tail of log files, which are written from events first."""
    n = F.col("event_id")
    line = F.when(n % 17 == 0, F.concat(F.lit("Traceback "), n.cast("string"))).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit(" "), "event_type"))
    base, paths = folder(spark, "logs"), []
    for label, odd in (("a", 0), ("b", 1)):
        target = f"{base}/{label}"
        _read(spark, sf_dir, "events").where(n % 2 == odd).select("event_id", line.alias("line")).coalesce(1).sortWithinPartitions("event_id").select("line").write.text(target)
        paths.append(target)
    return logs.tail(spark, paths, 200, label=lambda file: F.regexp_extract(file, "/([ab])/[^/]*$", 1))


CSV_STATS = """round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.5), 6) AS median"""


@register("csv_stations", f"""WITH r AS (SELECT event_id % 2 AS layout, event_type AS station, 'value' AS variable, value AS v FROM events UNION ALL SELECT 0, event_type, 'twice', value * 2 FROM events WHERE event_id % 2 = 0)
SELECT CAST(layout AS INTEGER) AS layout, variable, station, {CSV_STATS} FROM r WHERE isfinite(v) GROUP BY 1, 2, 3""")
def csv_stations(spark, sf_dir):
    """Files of two layouts, written from events, read by the scanner and cut into series by station."""
    events, base = _read(spark, sf_dir, "events"), folder(spark, "csv")
    base_rows = events.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.col("event_type").alias("station"), F.col("value").cast("string").alias("value"), (F.col("value") * 2).cast("string").alias("twice"), "event_id")
    base_rows.where("event_id % 2 = 0").select("twice", "time", "station", "value").write.option("header", True).option("sep", ";").csv(f"{base}/even")
    base_rows.where("event_id % 2 = 1").select("time", "station", "value").write.option("header", True).csv(f"{base}/odd")
    parts = [delimited.chunks(rows.withColumn("_file", F.lit("all"))).withColumn("layout", F.lit(int("twice" not in rows.columns))) for rows in delimited.layouts(spark, base)]
    return parts[0].unionByName(parts[1]).select("layout", "variable", "station", "mean", "std", "min", "max", "median")


@register("slug_names", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'export' WHEN 1 THEN 'a_b' WHEN 2 THEN 'caf_1' ELSE repeat('x', 59) END AS slug FROM pages")
def slug_names(spark, sf_dir):
    """Slugs in lower case, without marks at the ends."""
    n = F.col("page_id") % 4
    text = F.when(n == 0, " ?! ").when(n == 1, "__A--b ").when(n == 2, "Café 1").otherwise(F.concat(F.repeat(F.lit("X"), 59), F.lit(" y")))
    return _read(spark, sf_dir, "pages").select("page_id", texts.slugify(text).alias("slug"))




@register("hazard_variables", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'total_precipitation' ELSE 'own' END WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'total_precipitation' ELSE 'own' END ELSE 'own' END AS variable, CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 'forecast' ELSE 'analysis' END AS product FROM part""")
def hazard_variables(spark, sf_dir):
    """What to ask a dataset for, by hazard."""
    n = F.col("p_size") % 3
    dataset = F.when(n == 0, "reanalysis-cerra-single-levels").when(n == 1, "reanalysis-era5-land").otherwise("none")
    variable = catalog.hazard_variable(dataset, F.when(F.col("p_partkey") % 2 == 0, " Mean precipitation ").otherwise("Drought"), F.lit("own"))
    return _read(spark, sf_dir, "part").select("p_partkey", variable.alias("variable"), catalog.product_type(dataset, variable, F.lit("analysis")).alias("product"))


@register("temperatures", "SELECT event_id, CASE WHEN value > 200 AND value < 330 THEN round(value - 273.15, 6) END AS celsius, CASE WHEN value > -100 AND value < 60 THEN round(value + 273.15, 6) END AS kelvin FROM events")
def temperatures(spark, sf_dir):
    """Kelvins and degrees Celsius of the earth's surface."""
    return _read(spark, sf_dir, "events").select("event_id", F.round(scalars.as_celsius(F.col("value")), 6).alias("celsius"), F.round(scalars.as_kelvin(F.col("value")), 6).alias("kelvin"))


@register("model_answers", "SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN c_nationkey END AS nation, CASE WHEN c_custkey % 2 = 0 THEN [3, c_nationkey] END AS shape FROM customer")
def model_answers(spark, sf_dir):
    """JSON of models with and without a fence, and written shapes."""
    n, body = F.col("c_custkey") % 4, F.concat(F.lit('{"nation": '), F.col("c_nationkey").cast("string"), F.lit("}"))
    fence = lambda kind: F.concat(F.lit("Here:\n```" + kind + "\n"), body, F.lit("\n```\nbye"))
    answer = F.when(n == 0, body).when(n == 1, fence("json")).when(n == 2, fence("")).otherwise(F.concat(F.lit("no "), body))
    shape = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("(3, "), F.col("c_nationkey").cast("string"), F.lit(")"))).otherwise("3 by 4")
    return _read(spark, sf_dir, "customer").select("c_custkey", scalars.model_json(answer, "nation int")["nation"].alias("nation"), scalars.shape_of(shape).alias("shape"))


@register("available_sources", f"WITH {SOURCES} SELECT source_id FROM src WHERE n % 3 <> 0")
def available_sources(spark, sf_dir):
    """Sources without a schedule."""
    sources = _sources(spark, sf_dir)
    return listings.available(sources, sources.where(F.col("source_id").cast("long") % 3 == 0)).select("source_id")


@register("scanned_table", "SELECT count(*) AS rows_sampled, strftime(min(ts), '%Y-%m-%d') AS time_start, strftime(max(ts), '%Y-%m-%d') AS time_end, min(value) AS lat_min, max(value) AS lat_max FROM (SELECT * FROM events WHERE event_id % 2 = 0 ORDER BY event_id LIMIT 5000)")
def scanned_table(spark, sf_dir):
    """Columns, period and extent of a table's first rows, of a file that is written from events first."""
    base = folder(spark, "scan")
    rows = _read(spark, sf_dir, "events").where("event_id % 2 = 0").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("Date"), F.col("value").cast("string").alias("Latitude"))
    rows.coalesce(1).sortWithinPartitions("event_id").drop("event_id").withColumn("k", F.lit("x")).write.option("header", True).csv(base)
    return metadata.scan_table(delimited.read(spark, base)).select("rows_sampled", "time_start", "time_end", "lat_min", "lat_max")


PROGRESS = "p AS (SELECT o_custkey, o_orderkey % 4 AS phase, arg_max(CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'processing' END, o_orderkey) AS status FROM orders GROUP BY 1, 2)"


def _progress(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("processing")
    rows = _read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 4).alias("phase"), "o_orderkey", status.alias("status"))
    return rows.groupBy("o_custkey", "phase").agg(F.max_by("status", "o_orderkey").alias("status"))


@register("overall_status", f"WITH {PROGRESS} SELECT o_custkey, coalesce(max(status) FILTER (WHERE phase = 2), CASE WHEN max(status) FILTER (WHERE phase = 0) = 'completed' THEN 'metadata_only' ELSE 'pending' END) AS state FROM p GROUP BY 1")
def overall_status(spark, sf_dir):
    """The state of each source for its target phase."""
    return summarize.overall_status(_progress(spark, sf_dir), "o_custkey", 2)


@register("progress_totals", f"""WITH {PROGRESS}, s AS (SELECT o_custkey, CASE WHEN bool_or(phase > 0 AND status = 'completed') THEN 'processed' WHEN bool_or(phase > 0 AND status = 'failed') THEN 'failed' WHEN bool_or(phase = 0 AND status = 'completed') THEN 'metadata_only' ELSE 'pending' END AS state FROM p GROUP BY 1),
 t AS (SELECT greatest(count(*), 5000) AS total, count(*) FILTER (WHERE state = 'processed') AS processed, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'metadata_only') AS metadata_only, CAST(3 AS BIGINT) AS skipped FROM s) SELECT *, greatest(0, total - processed - failed - metadata_only - skipped) AS pending FROM t""")
def progress_totals(spark, sf_dir):
    """Totals over all sources, and what is pending."""
    return summarize.progress_totals(summarize.progress_rollup(_progress(spark, sf_dir), "o_custkey"), 5000, 3)


@register("full_summaries", """SELECT 'd' || l_suppkey AS dataset_name, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS variable, string_agg(DISTINCT CASE WHEN l_linestatus = 'O' THEN 'K' END, ', ') AS unit, min(l_quantity) AS latitude_min, max(l_tax) AS longitude_max, min(strftime(l_shipdate, '%Y-%m-%d')) AS time_start,
 round(avg(l_discount), 6) AS stats_mean, max(l_extendedprice) AS stats_max, count(*) AS chunk_count, 'Flood' AS hazard_type FROM lineitem GROUP BY 1""")
def full_summaries(spark, sf_dir):
    """One summary per dataset, with names, units, bounds and what its entry adds."""
    raw = _read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("dataset_name"), F.col("l_returnflag").alias("variable"), F.when(F.col("l_linestatus") == "O", "K").otherwise("").alias("unit"), F.col("l_quantity").alias("lat_min"), F.col("l_tax").alias("lon_max"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("time_start"), F.array("l_discount", F.lit(0.0), F.lit(0.0), "l_extendedprice", F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("stats"), F.col("l_orderkey").alias("chunk_index"),
    )
    rows = summarize.full_summary(payload.normalize(raw, falsy=False), "dataset_name", {"hazard_type": F.lit("Flood")})
    return rows.select("dataset_name", "variable", "unit", "latitude_min", "longitude_max", "time_start", F.round("stats_mean", 6).alias("stats_mean"), "stats_max", "chunk_count", "hazard_type")


@register("cited_datasets", """WITH c AS (SELECT p_partkey AS id, p_brand AS dataset_name, p_type AS source_id, 'v' || (p_size % 5) AS variable FROM part)
SELECT id FROM c WHERE (dataset_name = 'Brand#1' AND variable = 'v1') OR dataset_name = 'Brand#2' OR (source_id = (SELECT min(p_type) FROM part) AND variable = 'v2') OR source_id = (SELECT max(p_type) FROM part)""")
def cited_datasets(spark, sf_dir):
    """rows of cited pairs, by dataset first, else by source."""
    part = _read(spark, sf_dir, "part")
    ends = part.agg(F.min("p_type").alias("low"), F.max("p_type").alias("high"))
    none = F.lit("")
    pairs = ends.select(F.explode(F.array(
        F.struct(F.lit("Brand#1").alias("dataset_name"), F.lit("x").alias("source_id"), F.lit("v1").alias("variable")), F.struct(F.lit(" Brand#2 ").alias("dataset_name"), none.alias("source_id"), none.alias("variable")),
        F.struct(none.alias("dataset_name"), F.col("low").alias("source_id"), F.lit("v2").alias("variable")), F.struct(none.alias("dataset_name"), F.col("high").alias("source_id"), none.alias("variable")),
    )).alias("p")).select("p.*")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("dataset_name"), F.col("p_type").alias("source_id"), F.concat(F.lit("v"), (F.col("p_size") % 5).cast("string")).alias("variable"))
    return relate.cited_datasets(rows, pairs).select("id")


@register("short_circuit", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1 AS is_first, CASE o_custkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' ELSE 'pending' END AS status FROM orders")
def short_circuit(spark, sf_dir):
    """The first row of a URL is done, the others take over its status."""
    orders = _read(spark, sf_dir, "orders")
    outcome = orders.select("o_custkey").distinct().where("o_custkey % 3 < 2").withColumn("status", F.when(F.col("o_custkey") % 3 == 0, "failed").otherwise("completed"))
    return relate.short_circuit(orders, "o_custkey", ["o_totalprice", "o_orderkey"], outcome).select("o_orderkey", "is_first", "status")


@register("error_labels", """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'HTTP 403 (auth required) - h.org' WHEN 1 THEN 'HTTP 404 (URL dead)' WHEN 2 THEN 'HTTP 429 (rate-limited) - h.org' WHEN 3 THEN 'HTTP 418 - remote' WHEN 4 THEN 'HTTP 503 (server error) - h.org' WHEN 5 THEN 'Network error: ' || left(url, 120) WHEN 6 THEN 'Server returned HTML (likely a portal page, not data)' ELSE CASE WHEN contains(lower(url), 'html') THEN 'Server returned HTML (likely a portal page, not data)' ELSE left(url, 200) END END AS label FROM pages""")
def error_labels(spark, sf_dir):
    """failures in a few words."""
    n = F.col("page_id") % 8
    kind = F.when(n < 5, "http").when(n == 5, "connection").otherwise("value")
    code = F.when(n == 0, 403).when(n == 1, 404).when(n == 2, 429).when(n == 3, 418).when(n == 4, 503)
    message = F.when(n == 6, "got HTML").otherwise(F.col("url"))
    return _read(spark, sf_dir, "pages").select("page_id", catalog.error_label(kind, code, F.when(n.isin(0, 2, 4), "h.org"), message).alias("label"))


@register("names_from_urls", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Sis Agro Indicators' WHEN 1 THEN 'Ncep Reanalysis2' WHEN 2 THEN 'Gpm Imerg' WHEN 3 THEN 'SST MED' WHEN 4 THEN 'My Data' END AS name FROM pages""")
def names_from_urls(spark, sf_dir):
    """X11: a dataset's title as its portal writes it."""
    n = F.col("page_id") % 6
    url = F.when(n == 0, "https://cds.climate.copernicus.eu/api/sis-agro_indicators/").when(n == 1, "https://psl.noaa.gov/Datasets/ncep.reanalysis2/air.nc").when(n == 2, "https://x.nasa.gov/gpm_imerg/v07/a").when(n == 3, "https://m.eu/p/sst-med").when(n == 4, "https://a.org/x/my_data.nc").otherwise("https://a.org")
    portal = F.when(n == 2, "NASA").when(n == 3, "MARINE")
    return _read(spark, sf_dir, "pages").select("page_id", descriptions.name_from_url(url, portal).alias("name"))
