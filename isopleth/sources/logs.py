"""The merged tail of several log files."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seconds since its last change after which a file is left out.
STALE_SECONDS = 3600


def stamp(line: Column) -> Column:
    """The time at a line's beginning in one form; a line without one has a mark that sorts after all times."""
    found = F.regexp_extract(line, r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)", 1)
    return F.when(found == "", "~").otherwise(F.translate(found, "T,", " ."))


def stem(file: Column) -> Column:
    """A file's name without its suffix."""
    return F.regexp_extract(file, r"([^/]+?)(?:\.[^./]+)?$", 1)


def tail(spark: SparkSession, paths: list[str], most: int = 100, now: Column | None = None, label=stem) -> DataFrame:
    """The last `most` lines of all files together, in order: place, label, stamp, line.

    Of each file that changed in the last hour before `now` only its own last lines take part. Lines are ordered by
    time, those without a time at the end, then by file and place in it.
    """
    rows = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_modification_time").alias("changed"), F.monotonically_increasing_id().alias("n"))
    if now is not None:
        rows = rows.where(F.col("changed") > now - F.expr(f"INTERVAL {STALE_SECONDS} SECONDS"))
    last = rows.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("start"), F.desc("n")))).where(F.col("r") <= most)
    merged = last.select(stamp(F.col("value")).alias("stamp"), label(F.col("file")).alias("label"), (-F.col("r")).alias("r"), F.rtrim("value").alias("line"))
    newest = merged.orderBy(F.desc("stamp"), F.desc("label"), F.desc("r")).limit(most)
    order = Window.orderBy("stamp", "label", "r")  # of at most `most` rows
    return newest.select(F.row_number().over(order).alias("place"), "label", "stamp", "line")
