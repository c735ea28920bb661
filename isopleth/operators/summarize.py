"""Aggregations: chunk statistics, dataset summaries, facets, rollups of progress."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.sources.scratch import folder

#: Rows that one task sorts; blocks whose places may be broadcast, beyond it they are joined by a shuffle.
ROWS, BROADCAST_BLOCKS = 1 << 19, 200_000


def finite(value: str) -> Column:
    """Neither missing, NaN nor infinite."""
    v = F.col(value).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def chunk_stats8(cells: DataFrame, keys: list[str], value: str, exact: bool = True) -> DataFrame:
    """Mean, population deviation, min, max, 10th, 50th and 90th percentile (interpolated) and range of each chunk's finite cells.

    A chunk without finite cells gives no row. exact=False takes approximate percentiles, whose memory does not grow
    with a chunk's cells.
    """
    v = F.col(value).cast("double")
    at = F.array(*map(F.lit, (0.1, 0.5, 0.9)))
    found = cells.where(finite(value)).groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        (F.percentile(v, at) if exact else F.percentile_approx(v, at, 10000)).alias("p"), F.count("*").alias("n_cells"),
    )
    stats = [F.col("mean"), F.col("std"), F.col("min"), F.col("max"), F.col("p")[0].alias("p10"), F.col("p")[1].alias("median"), F.col("p")[2].alias("p90"), (F.col("max") - F.col("min")).alias("range")]
    names = ["mean", "std", "min", "max", "p10", "median", "p90", "range"]
    return found.select(*keys, *(F.round(c, 6).alias(n) for c, n in zip(stats, names)), "n_cells")


def _blocks(keys: list, schema):
    """For mapInArrow: sorted (keys, value, count) rows to blocks of one group each, with merged moments."""

    def changes(batch):
        found = np.zeros(batch.num_rows, bool)
        found[:1] = True
        for column in batch.columns[: len(keys)]:
            here, before = column.slice(1), column.slice(0, len(column) - 1)
            differ = pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.not_equal(pc.is_null(here), pc.is_null(before)))
            found[1:] |= np.asarray(differ.to_numpy(zero_copy_only=False), bool)
        return np.flatnonzero(found)

    def run(batches):
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = changes(batch)
            v, c = batch.column(len(keys)).to_numpy(), batch.column(len(keys) + 1).to_numpy()
            lengths = np.diff(np.append(starts, batch.num_rows))
            n = np.add.reduceat(c, starts)
            first = v[starts]
            mean = first + np.add.reduceat(c * (v - np.repeat(first, lengths)), starts) / n
            m2 = np.add.reduceat(c * (v - np.repeat(mean, lengths)) ** 2, starts)
            offsets = pa.array(np.append(starts, batch.num_rows).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (v, c)]
            numbers = [pa.array(x) for x in (np.arange(at, at + len(starts)), n, mean, m2, first, v[np.append(starts[1:], batch.num_rows) - 1])]
            yield pa.RecordBatch.from_arrays([*(x.take(pa.array(starts)) for x in batch.columns[: len(keys)]), *numbers, *lists], [*keys, "_at", "_n", "_mean", "_m2", "_min", "_max", "_values", "_counts"])
            at += len(starts)

    return run, ", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys) + ", _at long, _n long, _mean double, _m2 double, _min double, _max double, _values array<double>, _counts array<long>"


def counted(rows: DataFrame, count: str) -> DataFrame:
    """Equal rows of an Arrow batch as one, with how often it is there; equal rows of other batches stay apart, so nothing grows with the different ones."""
    columns = rows.columns

    def run(batches):
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by(columns, use_threads=False).aggregate([([], "count_all")]).select([*columns, "count_all"])
            yield from found.rename_columns([*columns, count]).combine_chunks().to_batches()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{ddl}, `{count}` long")


def group_stats8(cells: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """The same statistics, exactly, whatever share of the cells a group has; weight: a column of how often a row counts.

    Equal values of a batch are counted before anything is shuffled (those with a weight have been), written, and sorted
    by group and value over as many tasks as their number asks for. Runs of them become blocks with counts and moments,
    which are written. Moments of a group are those of its blocks, merged by counted deviations (Chan), so a mean far
    above the deviation costs no digits. Running counts over a group's blocks tell in which of them a percentile lies.
    So no task holds a group: it sorts ROWS rows, or holds one row per block of up to a batch of rows.
    """
    spark, v = cells.sparkSession, F.col(value).cast("double")
    cells = cells.where(finite(value)).select(*keys, (v + 0.0).alias("_v"), *([F.col(weight).cast("long").alias("_c")] if weight else []))
    counts = cells if weight else counted(cells, "_c")
    counts.write.parquet(path := folder(spark, "counts"))
    counts = spark.read.schema(counts.schema).parquet(path)
    run, ddl = _blocks(keys, counts.schema)
    path, tasks = folder(spark, "blocks"), max(1, math.ceil(counts.count() / ROWS))
    counts.repartitionByRange(tasks, *keys, "_v").sortWithinPartitions(*keys, "_v").mapInArrow(run, ddl).write.parquet(path)
    blocks = spark.read.schema(ddl).parquet(path)
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low, total = F.min("_min").over(group), F.sum("_n").over(group)
    running = blocks.drop("_values", "_counts").withColumns({"_below": before, "_total": total, "_m": low + F.sum(F.col("_n") * (F.col("_mean") - low)).over(group) / total})
    shares = {"p10": 0.1, "median": 0.5, "p90": 0.9}
    places = {f"{end}{name}": f(F.lit(p) * (F.col("_total") - 1)) for name, p in shares.items() for end, f in (("_l", F.floor), ("_h", F.ceil))}
    inside = {c: (F.col("_below") <= place) & (place < F.col("_below") + F.col("_n")) for c, place in places.items()}
    asked = running.select("_at", *(F.when(inside[c], place - F.col("_below")).alias(c) for c, place in places.items())).where(" or ".join(f"{c} is not null" for c in places))
    at = "element_at(_values, aggregate(_counts, named_struct('left', {0}, 'i', 1), (a, c) -> if(a.left < c, named_struct('left', cast(0 as bigint), 'i', a.i), named_struct('left', a.left - c, 'i', a.i + 1)), a -> a.i))"
    # once the place is inside a value's count, `left` is 0, and the counts that follow, at least 1, leave it there
    few = blocks.count() <= BROADCAST_BLOCKS
    found = blocks.select("_at", "_values", "_counts").join(F.broadcast(asked) if few else asked, "_at").select("_at", *(F.expr(f"if({c} is null, null, {at.format(c)})").alias(c) for c in places))
    sums = running.join(found, "_at", "left").groupBy(*keys).agg(
        F.max("_total").alias("n_cells"), F.max("_m").alias("mean"), F.sum(F.col("_m2") + F.col("_n") * (F.col("_mean") - F.col("_m")) * (F.col("_mean") - F.col("_m"))).alias("_m2"), F.min("_min").alias("min"), F.max("_max").alias("max"), *(F.max(c).alias(c) for c in places),
    )
    part = lambda p: F.lit(p) * (F.col("n_cells") - 1) - F.floor(F.lit(p) * (F.col("n_cells") - 1))
    stats = {"mean": F.col("mean"), "std": F.sqrt(F.col("_m2") / F.col("n_cells")), "min": F.col("min"), "max": F.col("max")}
    stats |= {name: F.col(f"_l{name}") + (F.col(f"_h{name}") - F.col(f"_l{name}")) * part(p) for name, p in shares.items()} | {"range": F.col("max") - F.col("min")}
    return sums.select(*keys, *(F.round(c, 6).alias(name) for name, c in stats.items()), "n_cells")


def joined(value: str, separator: str = ", ") -> Column:
    """Distinct values in ascending order as one string; missing and empty ones are left out."""
    return F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(value).cast("string"), F.lit("")))), separator)


def dataset_summary(chunks: DataFrame, key: str, variable: str = "variable") -> DataFrame:
    """One summary row per dataset from its chunk statistics: mean of means, min of mins, max of maxs, times as strings."""
    return chunks.groupBy(key).agg(
        joined(variable).alias("variables"), F.min("time_start").alias("time_start"), F.max("time_end").alias("time_end"),
        F.round(F.avg("mean"), 6).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"), F.count("*").alias("n_chunks"),
    ).withColumn("is_dataset_summary", F.lit(True))


def facet(df: DataFrame, key: str, limit: int) -> DataFrame:
    """Values and their counts, most frequent first (ties by value), at most `limit`."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def filtered_facet(df: DataFrame, within: str, key: str) -> DataFrame:
    """Counts of key's values within each value of another column, in one pass."""
    return df.groupBy(within, key).agg(F.count("*").alias("n"))


def datasets_listing(df: DataFrame, dataset: str, variable: str, order: str, sample: list[str]) -> DataFrame:
    """Per dataset its count, the sample columns of its first row and its variables with counts, most frequent first."""
    first = df.groupBy(dataset).agg(F.count("*").alias("n"), F.min_by(F.struct(*sample), order).alias("s"))
    facets = filtered_facet(df, dataset, variable).groupBy(dataset).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(variable).alias("v")))).alias("f"))
    text = F.array_join(F.transform("f", lambda x: F.concat(x["v"], F.lit(":"), (-x["k"]).cast("string"))), ",")
    return first.join(facets, dataset).select(dataset, "n", *(F.col("s")[c].alias(c) for c in sample), text.alias("variables"))


def phase_status_counts(progress: DataFrame, phase: str, status: str, statuses: list[str]) -> DataFrame:
    """Rows per phase and status, side by side, with the phase's total."""
    return progress.groupBy(phase).agg(*(F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in statuses), F.count("*").alias("total"))


def progress_rollup(progress: DataFrame, key: str) -> DataFrame:
    """One state per source: processed if a data phase completed, else failed, else metadata_only if phase 0 completed, else pending."""
    per = progress.groupBy(key).agg(
        F.bool_or((F.col("phase") > 0) & (F.col("status") == "completed")).alias("done"), F.bool_or((F.col("phase") > 0) & (F.col("status") == "failed")).alias("failed"),
        F.bool_or((F.col("phase") == 0) & (F.col("status") == "completed")).alias("meta"),
    )
    return per.select(key, F.when(F.col("done"), "processed").when(F.col("failed"), "failed").when(F.col("meta"), "metadata_only").otherwise("pending").alias("state"))


def distinct_values(df: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """Per column the number of distinct values and what to keep of them: the value, the list, or only the count."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    values = long.where("value is not null").select("name", "value").distinct()
    first = values.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("value"))).where(F.col("r") <= most)
    some = first.groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("some"))
    per = values.groupBy("name").agg(F.count("*").alias("n_values"), F.min("value").alias("one")).join(some, "name")
    return per.select("name", "n_values", F.when(F.col("n_values") == 1, F.col("one")).when(F.col("n_values") <= most, F.array_join("some", "|")).alias("kept"))


def overall_status(progress: DataFrame, key: str, target: int) -> DataFrame:
    """Per source the state of its target phase, else metadata_only where phase 0 is completed, else pending."""
    at = lambda phase: F.max(F.when(F.col("phase") == phase, F.col("status")))
    per = progress.groupBy(key).agg(at(target).alias("own"), at(0).alias("zero"))
    fallback = F.when((F.lit(target) > 0) & (F.col("zero") == "completed"), "metadata_only").otherwise("pending")
    return per.select(key, F.when(F.col("own").isin("completed", "failed", "processing"), F.col("own")).otherwise(fallback).alias("state"))


def progress_totals(states: DataFrame, total: int, skipped: int = 0) -> DataFrame:
    """One row of counts over the states of progress_rollup: total, processed, failed, metadata_only, skipped, pending.

    The total is at least the number of sources; what is left of it is pending, never less than none.
    """
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    found = states.agg(F.greatest(F.count("*"), F.lit(total)).alias("total"), count("processed"), count("failed"), count("metadata_only"))
    left = F.col("total") - F.col("processed") - F.col("failed") - F.col("metadata_only") - skipped
    return found.withColumns({"skipped": F.lit(skipped).cast("long"), "pending": F.greatest(F.lit(0), left)})


def full_summary(chunks: DataFrame, key: str, entry: dict[str, Column] | None = None) -> DataFrame:
    """One summary row per dataset of normalized chunks: names, units, bounds, times, statistics, count; entry fields fill what is missing.

    chunks have the columns of payload.normalize, and chunk_index as their order.
    """
    low, high = lambda c: F.min(c).alias(c), lambda c: F.max(c).alias(c)
    text = lambda c: F.nullif(joined(c), F.lit("")).alias(c)
    span = lambda f, c: f(F.nullif(F.col(c), F.lit(""))).alias(c)
    found = chunks.groupBy(key).agg(
        text("variable"), text("long_name"), text("unit"), low("latitude_min"), high("latitude_max"), low("longitude_min"), high("longitude_max"), span(F.min, "time_start"), span(F.max, "time_end"),
        F.avg("stats_mean").alias("stats_mean"), low("stats_min"), high("stats_max"), F.count("*").alias("chunk_count"), F.min_by("resolution_deg", "chunk_index").alias("resolution_deg"),
    ).withColumn("is_dataset_summary", F.lit(True))
    return found.withColumns({c: F.coalesce(F.col(c), v) if c in found.columns else v for c, v in (entry or {}).items()})
