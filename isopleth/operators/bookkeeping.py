"""Keyed tables of sources, runs, credentials and schedules, and the predicates of what is due, stale or stuck.

Each function takes tables as frames and gives the changed table; the time is a parameter, so a run can be repeated.
A caller keeps tables as versions of a collection.
"""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Minutes after which a running source is an orphan, days after which data are stale, minutes of silence that mean a stall.
ORPHAN_MINUTES, STALE_DAYS, STALL_MINUTES, HISTORY = 30, 30, 5, 20


def create(table: DataFrame, new: DataFrame, key: str, now: Column) -> DataFrame:
    """table and the new rows whose key it lacks, with their times of creation."""
    fresh = new.join(table.select(key), key, "left_anti").dropDuplicates([key])
    stamped = fresh.withColumns({"created_at": F.coalesce(F.col("created_at") if "created_at" in new.columns else F.lit(None).cast("timestamp"), now), "updated_at": now})
    return table.unionByName(stamped, allowMissingColumns=True).select(*table.columns)


def update(table: DataFrame, changes: DataFrame, key: str, now: Column) -> DataFrame:
    """table with the given values of each changed key (a missing value changes nothing); unknown columns are ignored."""
    columns = [c for c in changes.columns if c in table.columns and c not in (key, "id")]
    there = changes.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = table.join(there, table[key] == there["_k"], "left")
    new = {c: F.coalesce(f"_{c}", c) for c in columns} | ({"updated_at": F.when(F.col("_k").isNotNull(), now).otherwise(F.col("updated_at"))} if "updated_at" in table.columns else {})
    return joined.withColumns(new).select(*table.columns)


def set_status(sources: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Sources with new states. changes: source_id, status, error. A completed source gets the time and loses its error."""
    there = changes.select(F.col("source_id").alias("_k"), F.col("status").alias("_s"), F.nullif("error", F.lit("")).alias("_e"))
    joined, hit, done = sources.join(there, sources["source_id"] == there["_k"], "left"), F.col("_k").isNotNull(), F.col("_s") == "completed"
    return joined.withColumns(
        {
            "processing_status": F.coalesce("_s", "processing_status"),
            "error_message": F.when(hit & done, F.lit(None).cast("string")).otherwise(F.coalesce("_e", "error_message")),
            "last_processed_at": F.when(hit & done, now).otherwise(F.col("last_processed_at")),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        }
    ).select(*sources.columns)


def is_orphan(status: Column, updated: Column, now: Column, minutes: int = ORPHAN_MINUTES) -> Column:
    """Whether a source is said to be in work and was not touched for that long."""
    return (status == "processing") & (updated < now - F.expr(f"INTERVAL {minutes} MINUTES"))


def is_stale(status: Column, processed: Column, now: Column, days: int = STALE_DAYS) -> Column:
    """Whether a completed source was last processed too long ago."""
    return (status == "completed") & (processed < now - F.expr(f"INTERVAL {days} DAYS"))


def is_due(enabled: Column, next_run: Column, now: Column) -> Column:
    return enabled & (next_run <= now)


def is_stalled(heartbeat: Column, now: Column, minutes: int = STALL_MINUTES) -> Column:
    """Whether work gave no sign of life for that long."""
    return heartbeat < now - F.expr(f"INTERVAL {minutes} MINUTES")


def reset_orphans(sources: DataFrame, now: Column, minutes: int = ORPHAN_MINUTES) -> DataFrame:
    """Sources in work without progress become failed, with the reason."""
    orphan = F.coalesce(is_orphan(F.col("processing_status"), F.col("updated_at"), now, minutes), F.lit(False))
    reason = F.lit(f"Processing interrupted: no progress for more than {minutes} minutes")
    return sources.withColumn("_o", orphan).withColumns({"processing_status": F.when(F.col("_o"), "failed").otherwise(F.col("processing_status")), "error_message": F.when(F.col("_o"), reason).otherwise(F.col("error_message")), "updated_at": F.when(F.col("_o"), now).otherwise(F.col("updated_at"))}).drop("_o")


def soft_delete(sources: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Sources with the given ids no longer active."""
    there = keys.select(F.col("source_id").alias("_k")).distinct()
    joined = sources.join(there, sources["source_id"] == there["_k"], "left")
    hit = F.col("_k").isNotNull()
    return joined.withColumns({"is_active": F.when(hit, False).otherwise(F.col("is_active")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).select(*sources.columns)


def hard_delete(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """All tables (sources and what belongs to them) without the rows of the given source ids."""
    return {name: table.join(keys.select("source_id").distinct(), "source_id", "left_anti") for name, table in tables.items()}


def with_tags(sources: DataFrame, tags: list[str]) -> DataFrame:
    """Active sources that have any of the tags."""
    return sources.where(F.col("is_active") & F.arrays_overlap("tags", F.array(*map(F.lit, tags))))


def due_sources(sources: DataFrame, schedules: DataFrame, now: Column) -> DataFrame:
    """Active sources whose enabled schedule is due."""
    due = schedules.where(is_due(F.col("is_enabled"), F.col("next_run_at"), now)).select("source_id").distinct()
    return sources.where("is_active").join(due, "source_id", "left_semi")


def start_runs(runs: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """runs and new ones (run_id, source_id and more) in state started."""
    return runs.unionByName(new.withColumns({"status": F.lit("started"), "started_at": now}), allowMissingColumns=True).select(*runs.columns)


def complete_runs(runs: DataFrame, ends: DataFrame, now: Column) -> DataFrame:
    """runs with ends (run_id, status, chunks, error): time, duration in seconds, chunks and error."""
    there = ends.select(F.col("run_id").alias("_k"), F.col("status").alias("_s"), F.col("chunks").alias("_c"), F.col("error").alias("_e"))
    joined, hit = runs.join(there, runs["run_id"] == there["_k"], "left"), F.col("_k").isNotNull()
    new = {"status": F.col("_s"), "completed_at": now, "duration_seconds": (F.unix_micros(now) - F.unix_micros("started_at")) / 1e6, "chunks_processed": F.col("_c"), "error_message": F.col("_e")}
    return joined.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}).select(*runs.columns)


def history(runs: DataFrame, most: int = HISTORY) -> DataFrame:
    """The last runs of each source, newest first by place."""
    order = Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def set_keyed(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """table with rows of equal key replaced and others added; missing key parts are equal (a credential of no source is everyone's)."""
    same = [table[k].eqNullSafe(changes[k]) for k in key]
    return table.join(changes, same, "left_anti").unionByName(changes, allowMissingColumns=True).select(*table.columns)


def credentials(table: DataFrame, source: str | None) -> DataFrame:
    """Names and values of a source's credentials, or of those that belong to no source."""
    return table.where(F.col("source_id").eqNullSafe(F.lit(source))).select("credential_key", "credential_value")


def _field(text: str, low: int, high: int) -> set[int]:
    found = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        first, _, last = (f"{low}-{high}" if span == "*" else span).partition("-")
        end = int(last) if last else (high if step else int(first))
        found.update(range(int(first), end + 1, int(step or 1)))
    return found


def next_time(cron: str, after: datetime) -> datetime | None:
    """The first minute after a time that a five-field expression names; null where none comes within eight years.

    Where both day fields are given, either one is enough.
    """
    minute, hour, day, month, weekday = cron.split()
    minutes, hours, months = sorted(_field(minute, 0, 59)), sorted(_field(hour, 0, 23)), _field(month, 1, 12)
    days, weekdays = _field(day, 1, 31), {d % 7 for d in _field(weekday, 0, 7)}
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for ahead in range(366 * 8):
        date = at.date() + timedelta(days=ahead)
        by_day, by_weekday = date.day in days, date.isoweekday() % 7 in weekdays
        fits = by_day or by_weekday if day != "*" and weekday != "*" else by_day and by_weekday
        if date.month in months and fits:
            for h in hours:
                for m in minutes:
                    found = datetime(date.year, date.month, date.day, h, m)
                    if found >= at:
                        return found
    return None


@F.pandas_udf(T.TimestampType())
def next_run(cron: pd.Series, after: pd.Series) -> pd.Series:
    """The next time of each schedule after a time."""
    return pd.Series([None if c is None or pd.isna(a) else next_time(c, a.to_pydatetime().replace(tzinfo=None)) for c, a in zip(cron, after)], dtype="datetime64[ns]")


def set_schedules(schedules: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """schedules with new ones (source_id, cron_expression, is_enabled), each with its next run."""
    return set_keyed(schedules, changes.withColumn("next_run_at", next_run(F.col("cron_expression"), now)), ["source_id"])


def poll(schedules: DataFrame, requested: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(run requests that are due and were not made before, schedules advanced to their next run). requested: run_key."""
    due = is_due(F.col("is_enabled"), F.col("next_run_at"), now)
    key = F.concat_ws("_", "source_id", F.date_format("next_run_at", "yyyyMMddHHmmss"))
    requests = schedules.where(due).select("source_id", key.alias("run_key")).join(requested.select("run_key"), "run_key", "left_anti")
    advanced = schedules.withColumn("_d", F.coalesce(due, F.lit(False))).withColumn("next_run_at", F.when(F.col("_d"), next_run(F.col("cron_expression"), now)).otherwise(F.col("next_run_at"))).drop("_d")
    return requests, advanced.select(*schedules.columns)


def new_rows(table: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of an older store whose key the table lacks, to be moved over; running it again adds nothing."""
    return old.join(table.select(key), key, "left_anti").dropDuplicates([key])
