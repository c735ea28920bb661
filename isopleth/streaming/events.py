"""Event-time windows, deduplication and sliding rates: the same functions on batches and on streams."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(events: DataFrame, time: str, late: str) -> DataFrame:
    return events.withWatermark(time, late) if events.isStreaming else events


def tumbling(events: DataFrame, time: str, size: str, key: str, value: str, late: str = "1 hour") -> DataFrame:
    """Count and sum per key and window."""
    found = _watermarked(events, time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))
    return found.select(F.col("w.start").alias("start"), key, "n", "total")


def sliding(events: DataFrame, time: str, size: str, step: str, key: str, late: str = "1 hour") -> DataFrame:
    """Count per key and overlapping window."""
    found = _watermarked(events, time, late).groupBy(F.window(time, size, step).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after a gap without events."""
    found = _watermarked(events, time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def distinct_events(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One event per key: within the watermark on a stream, over all rows in a batch."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is, to a table in memory; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def ingest_directory(spark, folder: str, schema: str, handle, checkpoint: str, files_per_batch: int = 100, fmt: str = "csv", **options):
    """Hands each new file's rows, with their file name, to handle(batch, number) once; the checkpoint marks what is done.

    handle must be idempotent per batch number, as Spark may repeat the last batch after a failure.
    """
    stream = spark.readStream.format(fmt).schema(schema).options(**options).option("maxFilesPerTrigger", files_per_batch).load(folder)
    stream = stream.withColumn("file", F.col("_metadata.file_path"))
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest_stream(stream: DataFrame, into, name: str, checkpoint: str, transform=lambda rows: rows, add: str = "upsert"):
    """Writes a stream's batches to a Collection, each exactly once; waits until what there is has been read.

    A batch's number goes into the version that has its rows, in one file: a batch that is repeated, as the stream was
    stopped after the version was published, changes nothing, and one that was stopped before has left only files that no
    version names. add: `upsert`, or `append` for rows whose keys may repeat. Names tell streams into one collection apart.
    """
    write = getattr(into, add)
    query = stream.writeStream.foreachBatch(lambda batch, number: write(transform(batch), batch=(name, number)) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
