"""Delimited text files: sniffing, column classes, chunks by series, station or block."""

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.operators.summarize import chunk_stats8

# Tokens that mean a missing value, besides the empty one.
MISSING = ["mq", "MQ", "Mq", "/", "---", "--", "NULL", "null", "n/a", "N/A", "NaN", "nan", "NA"]
# Chunk and sample sizes.
BLOCK_ROWS, SAMPLE_ROWS, STATIONS, LISTED = 10_000, 100, 100, 10
TIME_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd"]


def sniff(lines: list[str], tab_file: bool = False) -> tuple[str, str | None]:
    """(separator pattern, comment prefix) from a file's first lines.

    The separator is the most frequent of comma, semicolon, bar and tab on the first line that is no comment, if there
    are two; else runs of blanks if there are two blanks together; else the file type's own.
    """
    prefix = next((p for p in ("#", "//") if any(line.startswith(p) for line in lines)), None)
    line = next((line for line in lines if line.strip() and not (prefix and line.startswith(prefix))), "")
    best = max(",;|\t", key=line.count)
    if line.count(best) >= 2:
        return best, prefix
    return (r"\s+", prefix) if "  " in line.strip() else ("\t" if tab_file else ",", prefix)


def _heads(spark: SparkSession, path) -> list:
    """(file, first twenty lines) of each file, by one pass in which only a file's first split gives lines."""

    def first(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            rows = [(f, v) for f, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if counts.setdefault(f, 0) < 20 and not counts.__setitem__(f, counts[f] + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["file", "value"])

    lines = spark.read.text(path, recursiveFileLookup=True).where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("file"), "value")
    heads: dict[str, list[str]] = {}
    for r in lines.mapInArrow(first, "file string, value string").collect():
        heads.setdefault(r.file, []).append(r.value)
    return sorted(heads.items())


def layouts(spark: SparkSession, path: str | list[str]) -> list[DataFrame]:
    """The rows of all files, one frame per different header and separator: strings under the header's names, _file, _row (order in a file), _block.

    Missing-value tokens become null; rows with too few or too many fields keep what fits; comment lines go. _block
    counts runs of BLOCK_ROWS rows from each file's beginning.
    """
    groups: dict[tuple, list[str]] = {}
    for file, head in _heads(spark, path):
        separator, prefix = sniff(head, file.endswith(".tsv"))
        split = separator if separator == r"\s+" else re.escape(separator)
        header = next((line for line in head if line.strip() and not (prefix and line.startswith(prefix))), "")
        names = [n.strip().strip('"') or f"column_{i}" for i, n in enumerate(re.split(split, header.strip()))]
        names = [n if n not in names[:i] else f"{n}_{i}" for i, n in enumerate(names)]
        groups.setdefault((separator, prefix, header.strip(), tuple(names)), []).append(file)
    return [_rows(spark, files, *layout) for layout, files in sorted(groups.items(), key=str)]


def _rows(spark: SparkSession, files: list[str], separator: str, prefix: str | None, header: str, names: tuple[str, ...]) -> DataFrame:
    where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row")]
    if separator == r"\s+":
        rows = spark.read.text(files).select(F.split(F.trim("value"), separator).alias("f"), F.trim("value").alias("line"), *where)
        rows = rows.where((F.col("line") != "") & (F.col("line") != header) & (~F.col("line").startswith(prefix) if prefix else F.lit(True)))
        rows = rows.select(*(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)), "_file", "_start", "_row")
    else:
        schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
        options = {"comment": prefix[0]} if prefix else {}
        rows = spark.read.schema(schema).csv(files, sep=separator, header=True, enforceSchema=True, mode="PERMISSIVE", **options).select("*", *where)
    firsts = rows.groupBy("_file", "_start").agg(F.min("_row").alias("_first"))
    value = lambda c: F.when(~F.trim(f"`{c}`").isin(*MISSING, ""), F.trim(f"`{c}`")).alias(c)
    # a split's rows follow each other; splits of a file are far apart
    block = F.col("_start") + F.floor((F.col("_row") - F.col("_first")) / BLOCK_ROWS)
    return rows.join(firsts, ["_file", "_start"]).select(*(value(n) for n in names), "_file", "_row", block.alias("_block"))


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The rows of all files in one frame; files with other headers are aligned by name."""
    frames = layouts(spark, path)
    found = frames[0]
    for frame in frames[1:]:
        found = found.unionByName(frame, allowMissingColumns=True)
    return found


def as_time(value: Column) -> Column:
    """A time written in one of the known forms: from a bare year, a year with a month after a point or dash, or six digits of day, month and year, to a time of day."""
    whole = F.coalesce(*(F.try_to_timestamp(value, F.lit(f)) for f in TIME_FORMATS))
    year = F.when(value.rlike(r"^(1[6-9]|20|21)\d\d$"), F.try_to_timestamp(F.concat(value, F.lit("-1-1")), F.lit("yyyy-M-d")))
    month = F.when(value.rlike(r"^(1[6-9]|20|21)\d\d[-.]\d{1,2}$"), F.try_to_timestamp(F.concat(F.translate(value, ".", "-"), F.lit("-1")), F.lit("yyyy-M-d")))
    short = F.when(value.rlike(r"^\d{6}$"), F.try_to_timestamp(value, F.lit("ddMMyy")))
    return F.coalesce(whole, month, year, short)


def classify(rows: DataFrame) -> dict[str, str]:
    """spatial, numeric, time or metadata for each column, from a bounded sample of rows.

    A name with lat or lon is spatial; a column is numeric if over half of its sampled values are; the first other
    column whose first value reads as a time is the time.
    """
    names = [c for c in rows.columns if not c.startswith("_")]
    sample = rows.orderBy("_row").limit(SAMPLE_ROWS)
    number = lambda c: F.avg(F.expr(f"try_cast(`{c}` AS double)").isNotNull().cast("double"))
    first = lambda c: as_time(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_row")))).isNotNull()
    found = sample.agg(*(number(c).alias(f"n{i}") for i, c in enumerate(names)), *(first(c).alias(f"t{i}") for i, c in enumerate(names))).first()
    kinds, timed = {}, False
    for i, c in enumerate(names):
        if re.search("lat|lon", c.lower()):
            kinds[c] = "spatial"
        elif not timed and found[f"t{i}"]:
            kinds[c], timed = "time", True
        else:
            kinds[c] = "numeric" if (found[f"n{i}"] or 0) > 0.5 else "metadata"
    return kinds


def _long(rows: DataFrame, columns: list[str], name: str, value: str) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in columns)))


def series_metadata(rows: DataFrame, columns: list[str], most: int = LISTED) -> DataFrame:
    """What each file's text columns say about its series: _file, metadata (names and texts).

    A column of one value gives that value; one of up to `most` gives `<column>_all`, the values in file order as JSON, and
    `<column>_count`; one of more gives nothing. Columns of far more values are left out before values are counted.
    """
    guess = rows.agg(*(F.approx_count_distinct(c).alias(c) for c in columns)).first()
    files = rows.select("_file").distinct()
    named = files.select("_file", F.explode(F.array(*map(F.lit, columns))).alias("name"))
    likely = rows.select("_file", "_row", _long(rows, columns, "name", "value").alias("x")).select("_file", "_row", "x.*").where("value is not null")
    per_file = likely.groupBy("_file", "name").agg(F.approx_count_distinct("value").alias("guess")).where(F.col("guess") <= 2 * most + 2) if max(guess) > most else likely.select("_file", "name").distinct()
    large = likely.select("_file", "name").distinct().join(per_file, ["_file", "name"], "left_anti")
    values = likely.join(per_file.select("_file", "name"), ["_file", "name"]).groupBy("_file", "name", "value").agg(F.min("_row").alias("first"))
    listed = values.groupBy("_file", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "value"))), lambda x: x["value"]).alias("v"))
    known = named.join(large, ["_file", "name"], "left_anti").join(listed, ["_file", "name"], "left").withColumn("v", F.coalesce("v", F.array().cast("array<string>"))).where(F.size("v") <= most)
    entry = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    several = F.array(entry(F.concat("name", F.lit("_all")), F.to_json("v")), entry(F.concat("name", F.lit("_count")), F.size("v").cast("string")))
    entries = known.select("_file", F.explode(F.when(F.size("v") == 1, F.array(entry(F.col("name"), F.get("v", F.lit(0))))).otherwise(several)).alias("e"))
    return entries.groupBy("_file").agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("metadata"))


def chunks(rows: DataFrame) -> DataFrame:
    """Chunk statistics of a delimited file: file, variable, station_col, station, block, time_start, time_end, the eight statistics and metadata.

    With a time column there is a chunk per variable and station, or per variable where no column has from two to a hundred
    values; without one, a chunk per variable and 10,000 rows. A series without stations carries what the text columns say
    (see series_metadata). A file without numbers gives no chunks.
    """
    kinds = classify(rows)
    of = lambda kind: [c for c, k in kinds.items() if k == kind]
    numeric, times, others = of("numeric"), of("time"), of("metadata")
    if not numeric:
        return rows.sparkSession.createDataFrame([], "_file string, variable string, mean double")
    stations: list[str] = []
    if times and others:
        counts = rows.agg(*(F.approx_count_distinct(c).alias(c) for c in others)).first()
        likely = [c for c in others if 1 < counts[c] <= 2 * STATIONS]
        exact = rows.agg(*(F.count_distinct(c).alias(c) for c in likely)).first() if likely else {}
        stations = [c for c in likely if 1 < exact[c] <= STATIONS]
    long = rows.withColumn("x", _long(rows, numeric, "variable", "value"))
    long = long.withColumn("s", _long(rows, stations, "col", "station")) if stations else long.withColumn("s", F.struct(F.lit(None).cast("string").alias("col"), F.lit(None).cast("string").alias("station")))
    block = F.lit(None).cast("long") if times else F.col("_block").cast("long")
    time = F.col(times[0]) if times else F.lit(None).cast("string")
    long = long.select("_file", F.col("x.variable").alias("variable"), F.col("s.col").alias("station_col"), F.col("s.station").alias("station"), block.alias("block"), F.expr("try_cast(x.value AS double)").alias("v"), time.alias("t"), "_row")
    keys = ["_file", "variable", "station_col", "station", "block"]
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    spans = long.where("v is not null").groupBy(*keys).agg(F.min_by("t", "_row").alias("time_start"), F.max_by("t", "_row").alias("time_end"))
    found = chunk_stats8(long, keys, "v").alias("a").join(spans.alias("b"), same)
    found = found.select("a.*", "b.time_start", "b.time_end")
    if not (times and others and not stations):
        return found.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    return found.join(series_metadata(rows, others), "_file", "left")
