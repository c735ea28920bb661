"""The ingest plan: files of any format to chunks, statistics, metadata, texts and vectors, kept in a collection."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.functions import descriptions, models
from isopleth.operators import collection as store
from isopleth.operators import payload, relate, summarize
from isopleth.plans.registry import register
from isopleth.plans.tables import CHUNKS, chunk_stats8
from isopleth.sources import archives
from isopleth.sources.scratch import folder

STATS = ["mean", "std", "min", "max", "p10", "median", "p90", "range"]


def described(chunks: DataFrame, verbosity: str = "medium", embed: models.Embed = models.hashed_embedding) -> DataFrame:
    """Chunks (source_id, variable, unit, place, time_start, time_end and the statistics) with chunk_index, id, text and embedding.

    A chunk's index counts within its source by variable, file, station column, time and place, then by its numbers, so it
    does not depend on partitions; its id is a name-based UUID of source and index, so that a source read again replaces
    its own rows. Chunks are sorted over all tasks and numbered by counts, so no source is held by one.
    """
    order = [c for c in ("variable", "file", "station_col", "time_start", "time_end", "place", *STATS) if c in chunks.columns]
    rows = relate.numbered(chunks, "source_id", order, "chunk_index").withColumn("chunk_index", F.col("chunk_index").cast("int"))
    rows = rows.withColumn("chunk_id", payload.chunk_ids(F.col("source_id"), F.col("chunk_index")))
    none = F.lit(None).cast("double")
    text = descriptions.describe(F.col("variable"), F.col("source_id"), F.col("time_start"), (none, none, none, none), F.array(*STATS), F.col("unit"), verbosity)
    return rows.withColumn("id", store.uuid5(F.col("chunk_id"))).withColumn("text", text).withColumn("embedding", models.embedded(F.col("text"), embed))


def load_chunks(spark: SparkSession, path: str, source_id: str, scratch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, errors) of all files below a path."""
    found = archives.load(spark, path, scratch or folder(spark, "unpacked"))
    chunks = found.where("error is null").withColumn("source_id", F.lit(source_id)).select("source_id", "file", "variable", "unit", "station_col", "place", "time_start", "time_end", *STATS)
    return chunks, found.where("error is not null").select("file", "error")


def ingest(spark: SparkSession, path: str, source_id: str, into: store.Collection, embed: models.Embed = models.hashed_embedding, run: str = "1") -> str:
    """Reads all files below a path, describes their chunks, replaces the source's rows in the collection, and gives the new version.

    Rows of an earlier run of the source go; other sources stay. Where no file gives a chunk the collection stays as it is.
    """
    chunks, _ = load_chunks(spark, path, source_id)
    rows = described(chunks, embed=embed).withColumn("run", F.lit(run))
    return into.replace("source_id", source_id, rows, unless_empty=True)


def metadata_rows(entries: DataFrame, embed: models.Embed = models.hashed_embedding) -> DataFrame:
    """Catalog entries that are kept by their description alone: source_id, text, embedding, is_metadata_only."""
    fields = ("dataset_name", "hazard", "data_type", "spatial_coverage", "spatial_resolution", "temporal_coverage", "temporal_resolution", "impact_sector", "region_country", "bias_corrected", "notes")
    text = descriptions.catalog_text({c: F.col(c) for c in fields if c in entries.columns})
    return entries.select("source_id", "dataset_name", text.alias("text"), F.lit(True).alias("is_metadata_only")).withColumn("embedding", models.embedded(F.col("text"), embed))


def phases(entries: DataFrame, done: DataFrame, phase: str = "phase", only: list[int] | None = None, resume: bool = True) -> DataFrame:
    """Entries to work on, in order of phase: those of the wanted phases, without those that a run before completed (source_id, phase)."""
    left = entries.where(F.col(phase).isin(only)) if only else entries
    if resume:
        left = left.join(done.select("source_id", phase), ["source_id", phase], "left_anti")
    return left.orderBy(phase, "source_id")


def with_fallback(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per entry its data chunks, or one metadata row where it has none: source_id, kind, n."""
    counted = chunks.groupBy("source_id").agg(F.count("*").alias("n"))
    return entries.join(counted, "source_id", "left").select("source_id", F.when(F.col("n") > 0, "data").otherwise("metadata").alias("kind"), F.coalesce("n", F.lit(1)).alias("n"))


@register("ingest_chunks", f"""WITH {CHUNKS}, n AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY day) - 1 AS chunk_index FROM chunks)
SELECT variable AS source_id, CAST(chunk_index AS INTEGER) AS chunk_index, variable || '_chunk_' || chunk_index AS chunk_id, 'Climate variable: ' || upper(left(variable, 1)) || substr(variable, 2) || ' (' || variable || ') | Dataset: ' || variable || ' | Time: ' || day || ' | Date: January 2024 | Mean: ' || CAST(CAST(round(mean, 2) AS DECIMAL(18, 2)) AS VARCHAR) || ' EUR | Range: ' || CAST(CAST(round(min, 2) AS DECIMAL(18, 2)) AS VARCHAR) || ' to ' || CAST(CAST(round(max, 2) AS DECIMAL(18, 2)) AS VARCHAR) || ' EUR' AS text FROM n""")
def ingest_chunks(spark, sf_dir):
    """Chunks to indexes, ids and texts."""
    chunks = chunk_stats8(spark, sf_dir).select(F.col("variable").alias("source_id"), "variable", F.lit("EUR").alias("unit"), F.lit("").alias("place"), F.col("day").alias("time_start"), F.col("day").alias("time_end"), *STATS)
    return described(chunks, "low").select("source_id", "chunk_index", "chunk_id", "text")


@register("phase_order", "SELECT 'p' || p_partkey AS source_id, p_size % 5 AS phase FROM part WHERE p_size % 5 IN (0, 1, 3) AND NOT (p_partkey % 3 = 0 AND p_size % 5 = 1)")
def phase_order(spark, sf_dir):
    """Entries of the wanted phases that are not yet completed."""
    entries = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source_id"), (F.col("p_size") % 5).alias("phase"), "p_partkey")
    done = entries.where("p_partkey % 3 = 0 and phase = 1").select("source_id", "phase")
    return phases(entries, done, only=[0, 1, 3]).select("source_id", "phase")


@register("metadata_fallback", "SELECT p_partkey AS source_id, CASE WHEN n > 0 THEN 'data' ELSE 'metadata' END AS kind, coalesce(n, 1) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey")
def metadata_fallback(spark, sf_dir):
    """Data chunks of each entry, or its metadata row."""
    entries = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("source_id"))
    return with_fallback(entries, spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 45").select(F.col("l_partkey").alias("source_id")))


@register("metadata_batch", "SELECT p_partkey AS source_id, 'Climate dataset: ' || p_name || '. Hazard: ' || p_type || '.' AS text FROM part")
def metadata_batch(spark, sf_dir):
    """Entries kept by their descriptions."""
    entries = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("source_id"), F.col("p_name").alias("dataset_name"), F.col("p_type").alias("hazard"))
    return metadata_rows(entries).select("source_id", "text")


def summaries(chunks: DataFrame) -> DataFrame:
    """One summary row per source beside its chunks, under the id of a summary."""
    rows = summarize.dataset_summary(chunks, "source_id")
    return rows.withColumn("chunk_id", payload.chunk_ids(F.col("source_id"), F.lit(0), "summary"))
