"""Listings of catalog entries and sources with what is known of each, their filters, orders and counts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.functions.texts import any_in

#: Size in bytes that a file of unknown size counts as.
UNKNOWN_SIZE = 10 << 30
#: Chunks beyond which a source has data.
WITH_DATA = 10


def with_state(entries: DataFrame, states: DataFrame) -> DataFrame:
    """Catalog entries with the ingest state of their source id, else of their dataset's name, else of the first state that names the dataset.

    entries: source_id, dataset_name. states: key, dataset_name, done, total, finished. Adds done, total, finished,
    is_partial; states without both counts tell nothing. Of several states of a key the furthest counts.
    """
    value = F.struct("done", "total", F.coalesce("finished", F.lit(False)).alias("finished"))
    by_key = states.groupBy("key").agg(F.max(value).alias("s"))
    by_name = states.where("dataset_name is not null").groupBy("dataset_name").agg(F.min_by(value, "key").alias("_c")).withColumnRenamed("dataset_name", "_n")
    found = entries.join(by_key.select(F.col("key").alias("_a"), F.col("s").alias("_sa")), F.col("source_id") == F.col("_a"), "left")
    found = found.join(by_key.select(F.col("key").alias("_b"), F.col("s").alias("_sb")), F.col("dataset_name") == F.col("_b"), "left")
    found = found.join(by_name, F.col("dataset_name") == F.col("_n"), "left").withColumn("_s", F.coalesce("_sa", "_sb", "_c"))
    told = F.when(F.col("_s.done").isNotNull() & (F.col("_s.total") != 0), F.col("_s"))
    found = found.withColumn("_s", told)
    return found.select(*entries.columns, "_s.done", "_s.total", "_s.finished", ((F.col("_s.done") < F.col("_s.total")) & ~F.col("_s.finished")).alias("is_partial"))


def processing_status(chunks: Column, dataset_chunks: Column, stored: Column) -> Column:
    """completed by counts, metadata_only with a chunk, else what is stored, else pending."""
    return F.when((chunks > 1) | (dataset_chunks > 5), "completed").when(chunks > 0, "metadata_only").otherwise(F.coalesce(stored, F.lit("pending")))


def sources_listing(catalog: DataFrame, stored: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per dataset of the catalog, and per stored source of a user, most chunks first, then by name.

    catalog: row_index, source_id, dataset_name, hazard, region_country, impact_sector, link. stored: source_id,
    dataset_name, url, status, hazard_type. counts: source_id, dataset_name, chunks. The entry with a web link stands
    for its dataset; hazards, regions and sectors of all its entries are joined; a stored source is found by any entry.
    """
    entries = catalog.withColumn("ds", F.coalesce(F.nullif("dataset_name", F.lit("")), "source_id"))
    per_source = counts.groupBy("source_id").agg(F.sum("chunks").alias("own"))
    per_dataset = counts.groupBy("dataset_name").agg(F.sum("chunks").alias("in_dataset")).withColumnRenamed("dataset_name", "_d")
    known = stored.select(F.col("source_id").alias("source_id"), F.struct("source_id", "url", "status", "hazard_type").alias("db"))
    joined = entries.join(per_source, "source_id", "left").join(known, "source_id", "left")
    web = F.coalesce(F.col("link").rlike("^https?://"), F.lit(False))
    text = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), ", "), F.lit(""))
    grouped = joined.groupBy("ds").agg(
        F.min_by(F.struct("source_id", "link", F.coalesce("own", F.lit(0)).alias("own")), F.struct(~web, "row_index")).alias("rep"),
        F.min_by("db", F.when(F.col("db").isNotNull(), F.col("row_index"))).alias("db"), text("hazard").alias("hazard"), text("region_country").alias("region_country"), text("impact_sector").alias("impact_sector"),
        F.sum(F.coalesce("own", F.lit(0))).alias("group_chunks"), F.count("*").alias("catalog_rows"),
    )
    grouped = grouped.join(per_source.select(F.col("source_id").alias("_s"), F.col("own").alias("_own")), F.col("db.source_id") == F.col("_s"), "left").join(per_dataset, F.col("ds") == F.col("_d"), "left")
    chunks = F.coalesce(F.when(F.col("db").isNotNull(), F.coalesce("_own", F.lit(0))), F.col("rep.own"))
    from_catalog = grouped.select(
        F.coalesce("db.source_id", "rep.source_id").alias("source_id"), F.col("ds").alias("dataset_name"), F.coalesce(F.nullif("db.url", F.lit("")), "rep.link", F.lit("")).alias("url"),
        processing_status(chunks, F.coalesce("in_dataset", F.lit(0)), F.col("db.status")).alias("status"), F.greatest("group_chunks", chunks).alias("chunks"),
        F.coalesce("hazard", F.nullif("db.hazard_type", F.lit(""))).alias("hazard_type"), "region_country", "impact_sector", "catalog_rows", F.lit(True).alias("from_catalog"),
    )
    users = stored.join(from_catalog.select("source_id"), "source_id", "left_anti").where(~F.startswith("source_id", F.lit("catalog_"))).withColumn("ds", F.coalesce(F.nullif("dataset_name", F.lit("")), "source_id"))
    users = users.join(per_source, "source_id", "left").join(per_dataset, F.col("ds") == F.col("_d"), "left")
    own = F.coalesce("own", F.lit(0))
    from_users = users.select(
        "source_id", F.col("ds").alias("dataset_name"), F.coalesce("url", F.lit("")).alias("url"), processing_status(own, F.coalesce("in_dataset", F.lit(0)), F.col("status")).alias("status"), own.alias("chunks"),
        F.nullif("hazard_type", F.lit("")).alias("hazard_type"), F.lit(None).cast("string").alias("region_country"), F.lit(None).cast("string").alias("impact_sector"), F.lit(0).cast("long").alias("catalog_rows"), F.lit(False).alias("from_catalog"),
    )
    return by_count(from_catalog.unionByName(from_users), "chunks", "dataset_name", "source_id")


def by_count(rows: DataFrame, count: str, name: str, fallback: str) -> DataFrame:
    """Most first, then by name, or by the fallback where there is none."""
    return rows.orderBy(F.desc(F.coalesce(count, F.lit(0))), F.coalesce(name, fallback, F.lit("")))


def newest_first(runs: DataFrame, created: str) -> DataFrame:
    """Runs by creation, newest first; one without a time counts as the oldest."""
    return runs.orderBy(F.desc(F.coalesce(created, F.lit(0))))


def smallest_first(files: DataFrame, size: str) -> DataFrame:
    """Files by size; those of unknown size last."""
    return files.orderBy(F.coalesce(size, F.lit(UNKNOWN_SIZE)).asc())


def by_text(rows: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Rows by a column's text without regard to case; a missing value counts as empty."""
    key = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return rows.orderBy(key.asc() if ascending else key.desc())


def clamped(k: Column, low: int = 1, high: int = 20) -> Column:
    """A wanted number of results within its bounds."""
    return F.greatest(F.lit(low), F.least(k, F.lit(high)))


def filtered(rows: DataFrame, search: str = "", state: str = "", hazard: str = "", place: str = "", origin: str = "") -> DataFrame:
    """A listing's rows that fit all given filters: text in name, id or hazard; state, by counts where they tell it; hazard; place; origin."""
    has = lambda c, part: F.contains(F.coalesce(c, F.lit("")), F.lit(part))
    keep = F.lit(True)
    if search:
        keep = keep & (has(F.lower("dataset_name"), search.lower()) | has(F.lower("source_id"), search.lower()) | has(F.lower("hazard_type"), search.lower()))
    if state:
        by_count = {"completed": F.col("chunks") > WITH_DATA, "metadata_only": F.col("chunks").between(1, WITH_DATA)}
        keep = keep & by_count.get(state, F.col("status") == state)
    if hazard:
        keep = keep & has(F.col("hazard_type"), hazard)
    if place:
        keep = keep & has(F.col("region_country"), place)
    if origin:
        keep = keep & (F.col("from_catalog") if origin == "catalog" else ~F.col("from_catalog"))
    return rows.where(keep)


def split_counts(rows: DataFrame, column: str) -> DataFrame:
    """Each value of a comma-joined column and the rows that have it."""
    each = F.array_distinct(F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != ""))
    return rows.select(F.explode(each).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def dashboard(datasets: DataFrame, chunks: str, hazard: str, place: str, metadata_only: str) -> dict[str, DataFrame]:
    """Counts of datasets with and without data, the ten largest, the ten most frequent hazards, all places."""
    bare = F.col(metadata_only) | (F.col(chunks) <= WITH_DATA)
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))
    count = lambda c: datasets.groupBy(named(c).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return {
        "totals": datasets.agg(F.count_if(~bare).alias("with_data"), F.count_if(bare).alias("metadata_only")),
        "largest": datasets.where(~bare).orderBy(F.desc(chunks), *datasets.columns[:1]).limit(10), "hazards": count(hazard).limit(10), "places": count(place),
    }


def sample_health(points: DataFrame, order: str, most: int = 1000) -> DataFrame:
    """Datasets and variables of the first points of a collection, with their counts: kind, value, n."""
    sample = points.orderBy(order).limit(most)
    long = sample.select(F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in ("dataset_name", "variable")))).alias("x"))
    return long.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def repeats_url(new: DataFrame, known: DataFrame) -> DataFrame:
    """New rows whose dataset has their URL already: without blanks around it, slashes at its end and regard to case."""
    url = lambda c: F.lower(F.rtrim(F.trim(c), F.lit("/")))
    return new.join(known.select("dataset_name", url(F.col("url")).alias("_u")), (new["dataset_name"] == known["dataset_name"]) & (url(new["url"]) == F.col("_u")), "left_semi")


def count_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per key the rows before and after a run, and whether it added any: what tells success where the run's end failed."""
    a, b = (df.groupBy(key).agg(F.count("*").alias(name)) for df, name in ((before, "n_before"), (after, "n_after")))
    both = a.join(b, key, "full").fillna(0, ["n_before", "n_after"])
    return both.withColumn("added", F.col("n_after") - F.col("n_before")).withColumn("success", F.col("added") > 0)


def pattern_truth(points: DataFrame, queries: list[tuple[str, dict[str, list[str]]]], id_col: str = "id", most: int = 10) -> DataFrame:
    """The first points, by id, that a query's patterns fit with a score of at least 2: query, id, score.

    A short list of queries (it is part of the plan) is matched in one pass. Patterns by kind: variable 2, and 1 more in
    the text; hazard 2; spatial 2; source 2; temporal 1. Columns that points lack hold nothing.
    """
    fields = {
        "variable": ["variable", "variable_name", "long_name", "standard_name"], "hazard": ["hazard_type", "hazard", "text"],
        "spatial": ["region_country", "spatial_coverage", "text", "dataset_name", "source_id", "long_name"], "source": ["source_id", "dataset_name", "title", "text"],
        "temporal": ["time_start", "time_end", "temporal_coverage", "text"],
    }
    weights = {"variable": 2, "hazard": 2, "spatial": 2, "source": 2, "temporal": 1}

    def hit(columns: list[str], patterns: list[str]) -> Column:
        found = F.lit(False)
        for c in columns:
            if c in points.columns:
                found = found | any_in(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), [p.lower() for p in patterns])
        return found

    scored = []
    for name, patterns in queries:
        if not any(patterns.get(kind) for kind in ("variable", "hazard", "spatial", "source")):
            continue
        score = F.lit(0)
        for kind, weight in weights.items():
            if patterns.get(kind):
                score = score + F.when(hit(fields[kind], patterns[kind]), weight).otherwise(0)
        if patterns.get("variable"):
            score = score + F.when(hit(["text"], patterns["variable"]), 1).otherwise(0)
        scored.append(F.struct(F.lit(name).alias("query"), score.alias("score")))
    rows = points.select(F.col(id_col).alias("id"), F.explode(F.filter(F.array(*scored), lambda s: s["score"] >= 2)).alias("s"))
    order = Window.partitionBy("query").orderBy("id")
    return rows.select("s.query", "id", "s.score").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def available(sources: DataFrame, schedules: DataFrame) -> DataFrame:
    """Sources that have no schedule yet."""
    return sources.join(schedules.select("source_id").distinct(), "source_id", "left_anti")


def with_schedule(entries: DataFrame, schedules: DataFrame) -> DataFrame:
    """Entries with their schedule and whether they have one."""
    known = schedules.select("source_id", F.col("cron_expression").alias("schedule"))
    return entries.join(known, "source_id", "left").withColumn("scheduled", F.col("schedule").isNotNull())
