"""The payload of chunks: names brought to one schema, extras kept, missing values left out."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields that are no extras.
STANDARD = [
    "dataset_name", "source_id", "variable", "long_name", "standard_name", "unit", "units", "time_start", "time_end", "temporal_frequency", "lat_min", "lat_max", "lon_min", "lon_max",
    "min_lat", "max_lat", "min_lon", "max_lon", "start_date", "end_date", "file_path", "chunk_index", "row_count", "shape", "format", "source",
    "station_id", "station_name", "station_names", "station_count", "description", "title", "institution", "source_description",
    "hazard_type", "data_type", "spatial_coverage", "region_country", "temporal_coverage_text", "impact_sector", "access_type", "catalog_source", "location_name", "is_metadata_only", "catalog_row_index",
]
# The order of a chunk's eight statistics.
STATS = ["mean", "std", "min", "max", "p10", "median", "p90", "range"]


def _truthy(df: DataFrame, name: str) -> Column:
    """Whether a value counts as given: neither missing, zero, false nor empty."""
    kind = df.schema[name].dataType
    there = F.col(name).isNotNull()
    if isinstance(kind, T.StringType):
        return there & (F.col(name) != "")
    return there & (F.col(name) != 0) if isinstance(kind, T.NumericType) else there & F.col(name) if isinstance(kind, T.BooleanType) else there


def either(df: DataFrame, first: str, second: str, falsy: bool = True) -> Column:
    """The first of two columns that is given. falsy: a zero or an empty string counts as not given, even if there is nothing else."""
    if first not in df.columns or second not in df.columns:
        return F.col(first) if first in df.columns else F.col(second) if second in df.columns else F.lit(None)
    return F.when(_truthy(df, first), F.col(first)).otherwise(F.col(second)) if falsy else F.coalesce(first, second)


def normalize(df: DataFrame, falsy: bool = True) -> DataFrame:
    """Chunk metadata under the schema's names, with eight stats_ columns and a map of extras.

    A stats column holds the eight statistics in order; shorter ones give none. shape may be an array or its text.
    Extras are all other columns that have a (finite) value, structs one level deep as name_field; values are strings.
    falsy=False keeps zeros (a latitude of 0) instead of passing on to the other name.
    """
    text = lambda c: F.nullif(c.cast("string"), F.lit(""))
    number = lambda a, b: either(df, a, b, falsy).cast("double")
    own = lambda c, kind="string": (F.col(c) if c in df.columns else F.lit(None)).cast(kind)
    shape = F.lit(None).cast("array<long>")
    if "shape" in df.columns:
        shape = F.col("shape").cast("array<long>") if isinstance(df.schema["shape"].dataType, T.ArrayType) else F.transform(F.regexp_extract_all("shape", F.lit(r"\d+"), F.lit(0)), lambda d: d.cast("long"))
    extras = []
    for field in df.schema.fields:
        if field.name in STANDARD or field.name == "stats":
            continue
        if isinstance(field.dataType, T.StructType):
            extras += [(f"{field.name}_{inner.name}", F.col(f"`{field.name}`.`{inner.name}`").cast("string")) for inner in field.dataType.fields]
        else:
            finite = F.col(f"`{field.name}`")
            if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                finite = F.when(~F.isnan(finite) & (F.abs(finite) < float("inf")), finite)
            extras.append((field.name, (F.to_json(F.col(f"`{field.name}`")) if isinstance(field.dataType, (T.ArrayType, T.MapType)) else finite).cast("string")))
    known = F.map_filter(F.create_map(*(x for name, value in extras for x in (F.lit(name), value))), lambda _, v: v.isNotNull()) if extras else F.create_map().cast("map<string,string>")
    stats = [F.when(F.size("stats") >= 8, F.get("stats", F.lit(i))) if "stats" in df.columns else F.lit(None).cast("double") for i in range(8)]
    return df.select(
        F.coalesce(own("dataset_name"), own("source_id"), F.lit("unknown")).alias("dataset_name"), F.coalesce(own("source_id"), F.lit("unknown")).alias("source_id"), F.coalesce(own("variable"), F.lit("unknown")).alias("variable"),
        own("long_name").alias("long_name"), own("standard_name").alias("standard_name"), either(df, "unit", "units").cast("string").alias("unit"),
        text(either(df, "time_start", "start_date")).alias("time_start"), text(either(df, "time_end", "end_date")).alias("time_end"), own("temporal_frequency").alias("temporal_frequency"),
        number("lat_min", "min_lat").alias("latitude_min"), number("lat_max", "max_lat").alias("latitude_max"), number("lon_min", "min_lon").alias("longitude_min"), number("lon_max", "max_lon").alias("longitude_max"),
        *(s.cast("double").alias(f"stats_{n}") for s, n in zip(stats, STATS)), shape.alias("grid_shape"), number("resolution_deg", "resolution").alias("resolution_deg"),
        either(df, "file_path", "source").cast("string").alias("file_path"), own("chunk_index", "long").alias("chunk_index"), own("row_count", "long").alias("row_count"), known.alias("extras"),
    )


def to_payload(normalized: DataFrame) -> Column:
    """A map of all values that are neither missing, NaN nor infinite, as strings; extras win over fields of the same name."""
    parts = []
    for field in normalized.schema.fields:
        if field.name == "extras":
            continue
        value = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
        parts += [F.lit(field.name), F.to_json(value) if isinstance(field.dataType, T.ArrayType) else value.cast("string")]
    fields = F.map_filter(F.create_map(*parts), lambda k, v: v.isNotNull() & ~F.map_contains_key(F.col("extras"), k))
    return F.map_concat(fields, "extras")


def inject_context(rows: DataFrame, context: dict[str, Column], custom: Column | None = None, payload: str = "extras") -> DataFrame:
    """Overlays context columns where they have a value; custom entries enter the payload map only under keys that it lacks."""
    rows = rows.withColumns({name: F.coalesce(value, F.col(name)) if name in rows.columns else value for name, value in context.items()})
    if custom is None:
        return rows
    new = F.map_filter(custom, lambda k, v: ~F.map_contains_key(F.col(payload), k))
    return rows.withColumn(payload, F.map_concat(new, payload))


def flatten_chunk(hits: DataFrame, meta: str = "metadata") -> DataFrame:
    """A hit's metadata as columns of their own beside rank, score, source_id and variable; nested values as JSON."""
    struct = hits.schema[meta].dataType
    inner = {f.name: f for f in struct.fields}
    pick = lambda c: F.coalesce(*([F.nullif(F.col(f"{meta}.{c}"), F.lit(""))] if c in inner else []), *([F.col(c)] if c in hits.columns else []), F.lit(None).cast("string")).alias(c)
    others = [f for f in struct.fields if f.name not in ("rank", "score", "source_id", "variable")]
    flat = [(F.to_json(F.col(f"{meta}.{f.name}")) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"{meta}.{f.name}")).alias(f.name) for f in others]
    return hits.select("rank", "score", pick("source_id"), pick("variable"), *flat)


def source_as_entry(sources: DataFrame) -> DataFrame:
    """Sources under a catalog entry's names; what a source lacks is empty."""
    own = lambda c: F.coalesce(F.col(c).cast("string") if c in sources.columns else F.lit(None).cast("string"), F.lit(""))
    period = F.when(F.col("time_start").isNotNull() | F.col("time_end").isNotNull(), F.concat(own("time_start"), F.lit("/"), own("time_end"))).otherwise("") if {"time_start", "time_end"} <= set(sources.columns) else F.lit("")
    notes = F.coalesce(F.array_join("variables", ", "), F.lit("")) if "variables" in sources.columns else F.lit("")
    names = {"source_id": "dataset_name", "hazard_type": "hazard", "url": "link", "region_country": "region_country", "spatial_coverage": "spatial_coverage", "impact_sector": "impact_sector", "format": "data_type"}
    entry = F.when(own("source_id") == "", "user_source").otherwise(F.replace(F.lower(own("source_id")), F.lit(" "), F.lit("_")))
    return sources.select(entry.alias("entry_id"), *(own(a).alias(b) for a, b in names.items()), period.alias("temporal_coverage"), notes.alias("notes"))


def chunk_ids(source: Column, number: Column, kind: str = "chunk") -> Column:
    """Ids of a source's chunks, of portal chunks (kind portal_chunk), of time-stamped ones (kind the stamp); a summary has none of the numbers."""
    return F.concat_ws("_", source, F.lit("summary")) if kind == "summary" else F.concat_ws("_", source, F.lit(kind), number.cast("string"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
