"""Texts of chunks and catalog entries, locations, topic queries, and the lines of a variable enricher."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isopleth.functions.catalog import region
from isopleth.functions.texts import url_host, url_path

# Readable names of variables.
VARIABLE_NAMES = {
    "2m_temperature": "2-meter temperature", "temperature_2m": "2-meter temperature", "t2m": "2-meter temperature", "total_precipitation": "total precipitation", "tp": "total precipitation",
    "precipitation": "precipitation", "10m_wind_speed": "10-meter wind speed", "wind_speed": "wind speed", "surface_pressure": "surface pressure", "msl": "mean sea level pressure",
    "geopotential": "geopotential", "z": "geopotential", "band_1": "satellite image band 1", "air": "air temperature", "gray": "terrain intensity",
    "pm25": "PM2.5 particulate matter", "pm10": "PM10 particulate matter", "no2": "nitrogen dioxide", "o3": "ozone", "co": "carbon monoxide",
}

# Places of known stations.
STATIONS = {"Berlin-Tempelhof": "Berlin, Germany", "De Bilt": "De Bilt, Netherlands", "Wien Hohe Warte": "Vienna, Austria", "Praha-Klementinum": "Prague, Czech Republic"}

# The search text of each topic.
TOPIC_QUERIES = {
    "drought": "SPEI drought index climate data",
    "temperature": "ERA5 temperature climate reanalysis data",
    "precipitation": "IMERG GPM precipitation rainfall satellite data",
    "wildfire": "CAMS GFAS wildfire fire emissions burned area",
    "flood": "precipitation flood inundation soil moisture water",
    "sea level": "GRACE sea level rise ice sheet mass loss",
    "ice": "GRACE ice sheet mass loss cryosphere glacier",
    "aerosol": "CAMS MERRA-2 aerosol dust particulate reanalysis",
    "co2": "CAMS CO2 carbon dioxide greenhouse gas atmospheric concentration",
    "soil moisture": "ERA5 Land soil moisture volumetric",
    "water storage": "GRACE-FO terrestrial water storage anomaly",
    "wind": "ERA5 wind speed gust storm cyclone",
    "marine": "sea surface temperature SST marine heatwave ocean heat",
    "emissions": "CAMS emissions wildfire carbon atmospheric composition",
}

# What a content type says about a file's format.
CONTENT_TYPES = {
    "application/x-netcdf": "netcdf", "application/netcdf": "netcdf", "application/x-hdf": "hdf5", "application/x-hdf5": "hdf5", "image/tiff": "geotiff", "image/geotiff": "geotiff",
    "text/csv": "csv", "application/zip": "zip", "application/gzip": "gz", "application/x-gzip": "gz", "application/grib": "grib",
}
# What the end of a path says about it; the first that matches counts.
PATH_ENDS = [
    (".nc", "netcdf"), (".nc4", "netcdf"), (".hdf", "hdf5"), (".h5", "hdf5"), (".hdf5", "hdf5"), (".he5", "hdf5"), (".tif", "geotiff"), (".tiff", "geotiff"), (".csv", "csv"), (".tsv", "csv"), (".txt", "csv"),
    (".asc", "ascii"), (".zip", "zip"), (".gz", "gz"), (".tar", "tar"), (".grib", "grib"), (".grib2", "grib"), (".grb", "grib"), (".grb2", "grib"), (".zarr", "zarr"),
]


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def _two(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.2f", value.cast("double")))


def title(text: Column) -> Column:
    """Each run of letters with a capital first letter."""
    part = lambda run: F.concat(F.regexp_extract(run, r"^[^\p{L}]*", 0), F.initcap(F.regexp_extract(run, r"\p{L}*$", 0)))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"[^\p{L}]*\p{L}*"), F.lit(0)), part), "")


def readable(variable: Column) -> Column:
    """A variable's readable name: the known one, else its own in title case."""
    return F.coalesce(_map(VARIABLE_NAMES)[F.lower(variable)], title(F.replace(variable, F.lit("_"), F.lit(" "))))


def month_of(time: Column) -> Column:
    """Month and year of a time string that begins with a date; null where it doesn't."""
    day = F.when(F.contains(time, F.lit("T")), F.substring_index(time, "T", 1)).otherwise(F.get(F.split(F.trim(time), r"\s+"), F.lit(0)))
    return F.date_format(F.coalesce(F.try_to_timestamp(day, F.lit("yyyy-M-d")), F.try_to_timestamp(day, F.lit("yyyy/M/d"))), "MMMM yyyy")


def statistics_text(stats: Column, unit: Column, verbosity: str = "medium") -> list[Column]:
    """The parts that tell the statistics (mean, std, min, max, p10, median, p90, range); none where there are fewer than eight."""
    tail = F.when(F.coalesce(unit, F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), unit))
    value = lambda i: _two(F.get(stats, F.lit(i)))
    one = lambda label, i: F.concat(F.lit(f"{label}: "), value(i), tail)
    span = F.concat(F.lit("Range: "), value(2), F.lit(" to "), value(3), tail)
    parts = {
        "low": [one("Mean", 0), span],
        "medium": [one("Mean", 0), one("Standard deviation", 1), span, one("Median", 5), one("90th percentile", 6)],
        "high": [one("Mean", 0), one("Standard deviation", 1), one("Minimum", 2), one("Maximum", 3), one("Median", 5), one("10th percentile", 4), one("90th percentile", 6), one("Range", 7)],
    }[verbosity]
    return [F.when(F.size(stats) >= 8, part) for part in parts]


def describe(variable: Column, source: Column, time: Column, box: tuple[Column, Column, Column, Column], stats: Column, unit: Column, verbosity: str = "medium", point: tuple[Column, Column] | None = None) -> Column:
    """A chunk's description; parts without a value vanish. box: south, north, west, east. point: latitude, longitude, used where there is no box."""
    name = F.coalesce(variable, F.lit("unknown"))
    south, north, west, east = box
    parts = [
        F.concat(F.lit("Climate variable: "), readable(name), F.lit(" ("), name, F.lit(")")),
        F.when(~F.coalesce(source, F.lit("")).isin("", "unknown"), F.concat(F.lit("Dataset: "), source)),
        F.when(time != "", F.concat(F.lit("Time: "), time)), F.concat(F.lit("Date: "), month_of(time)),
        F.concat(F.lit("Latitude: "), _two(south), F.lit("° to "), _two(north), F.lit("°")), F.concat(F.lit("Longitude: "), _two(west), F.lit("° to "), _two(east), F.lit("°")),
    ]
    if point:
        none = south.isNull() & north.isNull() & west.isNull() & east.isNull()
        parts.append(F.when(none, F.concat(F.lit("Location: "), _two(point[0]), F.lit("°N, "), _two(point[1]), F.lit("°E"))))
    return F.concat_ws(" | ", *parts, *statistics_text(stats, unit, verbosity))


def location(region_name: Column, coverage: Column, dataset: Column) -> Column:
    """Where an entry's data are: its region, else its coverage, with the region that the dataset's name tells for a regional one."""
    extent = F.trim(coverage)
    regional = F.coalesce(region(dataset), F.lit("Regional"))
    found = F.when(F.lower(extent) == "global", "Global").when(F.lower(extent) == "regional", regional).otherwise(extent)
    return F.when(region_name != "", F.trim(region_name)).when(coverage != "", found).otherwise("Unknown")


def station_place(name: Column) -> Column:
    return _map(STATIONS)[name]


def catalog_text(entry: dict[str, Column], context: Column | None = None) -> Column:
    """A catalog entry's description in sentences. entry has columns by the names of the catalog's fields; a missing field is skipped."""
    get = lambda name: F.nullif(entry.get(name, F.lit(None).cast("string")), F.lit(""))
    said = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    none = lambda value: F.nullif(value, F.lit(""))
    place = location(entry.get("region_country", F.lit(None).cast("string")), entry.get("spatial_coverage", F.lit(None).cast("string")), entry.get("dataset_name", F.lit(None).cast("string")))
    parts = [
        said("Climate dataset", get("dataset_name")), said("Hazard", get("hazard")), said("Type", get("data_type")),
        said("Coverage", none(F.concat_ws(" ", get("spatial_coverage"), F.concat(F.lit("at "), get("spatial_resolution"))))),
        said("Period", none(F.concat_ws(", ", get("temporal_coverage"), get("temporal_resolution")))), said("Sectors", get("impact_sector")),
        F.when(~place.isin("Unknown", ""), said("Region", place)), F.when(F.lower(get("bias_corrected")) == "yes", "Bias-corrected version available"), said("Notes", get("notes")),
    ]
    return F.concat(F.concat_ws(". ", *parts, *([F.nullif(context, F.lit(""))] if context is not None else [])), F.lit("."))


def topic_queries(found: Column) -> Column:
    """One search text per topic where there are at least two."""
    each = F.transform(found, lambda t: F.coalesce(_map(TOPIC_QUERIES)[t], F.concat(t, F.lit(" climate data"))))
    return F.when(F.size(found) > 1, each).otherwise(F.array().cast("array<string>"))


def format_of(content_type: Column, path: Column) -> Column:
    """A file's format by its content type, else by the end of its path."""
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    by_path = F.lit(None).cast("string")
    for end, name in reversed(PATH_ENDS):
        by_path = F.when(F.endswith(F.lower(path), F.lit(end)), name).otherwise(by_path)
    return F.coalesce(_map(CONTENT_TYPES)[kind], by_path)


def enrichments(lines: DataFrame, line: str = "line") -> DataFrame:
    """variable, long_name, description of lines of the form VARIABLE: a | LONG_NAME: b | DESCRIPTION: c; of a variable's lines the last by its place (column n)."""
    parts = F.transform(F.split(line, r"\|"), lambda x: F.trim(x))

    def value(label: str) -> Column:
        own = F.filter(parts, lambda p: F.startswith(p, F.lit(label)))
        last = F.get(F.reverse(own), F.lit(0))
        return F.nullif(F.trim(F.replace(last, F.lit(label), F.lit(""))), F.lit(""))

    some = lines.where(F.col(line).contains("VARIABLE:") & F.col(line).contains("LONG_NAME:"))
    found = some.select("n", value("VARIABLE:").alias("variable"), value("LONG_NAME:").alias("long_name"), value("DESCRIPTION:").alias("description")).where("variable is not null and long_name is not null")
    return found.groupBy("variable").agg(F.max_by(F.struct("long_name", "description"), "n").alias("e")).select("variable", "e.long_name", "e.description")


def enriched(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with long_name and variable_description from an enrichment table where it knows the variable."""
    known = table.select(F.col("variable").alias("_v"), F.col("long_name").alias("_l"), F.col("description").alias("_d"))
    own = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    joined = rows.join(known, rows["variable"] == known["_v"], "left")
    return joined.withColumns({"long_name": F.coalesce("_l", own("long_name")), "variable_description": F.coalesce("_d", own("variable_description"))}).drop("_v", "_l", "_d")


def name_from_url(url: Column, portal: Column) -> Column:
    """A dataset's title from its URL, as its portal writes them: by the last part of the path, the part after Datasets, the last long part, or the file's name."""
    path = F.btrim(url_path(url), F.lit("/"))
    host, parts = F.coalesce(url_host(url), F.lit("")), F.split(path, "/")
    last = F.element_at(parts, -1)
    words = lambda x: F.translate(x, "-_", "  ")
    behind = F.get(F.split(F.element_at(F.split(path, "atasets/"), -1), "/"), F.lit(0))
    long = F.get(F.filter(F.reverse(parts), lambda x: (x != "") & ~F.startswith(x, F.lit(".")) & (F.char_length(x) > 3)), F.lit(0))
    stem = F.regexp_replace(last, r"\.[^.]*$", "")
    listed = F.contains(path, F.lit("atasets/"))
    found = F.when((portal == "CDS") | F.contains(host, F.lit("cds.climate.copernicus.eu")), title(words(last)))
    found = found.when(((portal == "NOAA") | F.contains(host, F.lit("psl.noaa.gov"))) & listed, title(F.translate(behind, "._", "  ")))
    found = found.when((portal == "NASA") & long.isNotNull(), title(words(long))).when(portal == "MARINE", F.upper(words(last)))
    return found.when(F.char_length(stem) > 2, title(words(stem)))
