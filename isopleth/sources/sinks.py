"""Exports: CSV with a fixed column order, JSON with a cap that is reported."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that come first, in this order, where they are present.
FIRST_COLUMNS = [
    "rank", "score", "source_id", "dataset_name", "variable", "long_name", "standard_name", "units", "unit", "time_start", "time_end", "temporal_frequency",
    "lat_min", "lat_max", "lon_min", "lon_max", "stats_mean", "stats_min", "stats_max", "stats_std", "region_country", "spatial_coverage", "hazard_type", "impact_sector",
]
JSON_ROWS = 50_000


def column_order(columns: list[str]) -> list[str]:
    """Known columns first, the others in alphabetical order."""
    return [c for c in FIRST_COLUMNS if c in columns] + sorted(c for c in columns if c not in FIRST_COLUMNS)


def _flat(field: T.StructField) -> Column:
    nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
    return (F.to_json(field.name) if nested else F.col(field.name).cast("string")).alias(field.name)


def export_csv(rows: DataFrame, path: str) -> None:
    """Writes rows as CSV parts with a header; nested values as JSON, missing ones empty. Each file begins with a byte order mark."""
    names = column_order(rows.columns)
    flat = rows.select(*(_flat(rows.schema[c]) for c in names))
    marked = flat.withColumnRenamed(names[0], chr(0xFEFF) + names[0])
    marked.write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def export_json(rows: DataFrame, most: int = JSON_ROWS) -> tuple[list[str], bool]:
    """(at most `most` rows as JSON texts, whether there were more)."""
    found = [r.j for r in rows.select(F.to_json(F.struct("*")).alias("j")).limit(most + 1).collect()]
    return found[:most], len(found) > most


def export_golden(queries: DataFrame, path: str, facts: dict[str, object]) -> None:
    """Writes annotated queries as JSON lines, each with the facts of the whole set (version, collection, counts)."""
    queries.select("*", *(F.lit(value).alias(name) for name, value in facts.items())).write.mode("overwrite").json(path)
