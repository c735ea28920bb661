"""Column expressions on texts, URLs, names and times."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topics with the strings that reveal them, in the order in which they are reported.
TOPICS = [
    ("drought", ["drought", "dry spell", "aridity", "spei", "pdsi", "spi "]),
    ("temperature", ["temperature", "warming", "heat", "thermal", "t2m"]),
    ("precipitation", ["precipitation", "rainfall", "rain", "monsoon", "imerg"]),
    ("wildfire", ["wildfire", "fire", "burned area", "fire emission", "gfas"]),
    ("flood", ["flood", "inundation", "submerg"]),
    ("sea level", ["sea level", "sea-level", "tide", "grace"]),
    ("ice", ["ice sheet", "ice loss", "glacier", "cryosphere", "ice mass"]),
    ("aerosol", ["aerosol", "dust", "particulate", "pm2.5", "pm10", "saharan"]),
    ("co2", ["co2", "carbon dioxide", "greenhouse gas", "ghg", "ppm"]),
    ("soil moisture", ["soil moisture", "soil water"]),
    ("water storage", ["water storage", "terrestrial water", "grace-fo"]),
    ("wind", ["wind speed", "wind gust", "cyclone", "hurricane", "storm"]),
    ("marine", ["marine heatwave", "sst", "sea surface temperature", "ocean heat"]),
    ("emissions", ["emission", "cams"]),
]

# What reveals a question's type; the first type with a match counts.
QUESTION_TYPES = [
    ("variable_list", ["what variables", "which variables", "list variables", "available variables", "what data", "what fields"]),
    ("comparison", ["compare", "difference", "versus", "vs", "contrast"]),
    ("statistical", ["average", "mean", "median", "minimum", "maximum", "statistics", "summary"]),
    ("temporal", ["trend", "over time", "historical", "change", "increase", "decrease", "when"]),
]

# File suffixes and their formats.
FORMATS = {
    ".nc": "netcdf", ".nc4": "netcdf", ".grib": "grib", ".grib2": "grib", ".grb2": "grib", ".h5": "hdf5", ".hdf": "hdf5", ".he5": "hdf5",
    ".tif": "geotiff", ".tiff": "geotiff", ".asc": "ascii", ".csv": "csv", ".tsv": "csv", ".zarr": "zarr", ".zip": "zip", ".gz": "gz", ".tar": "tar", ".txt": "csv",
}


def any_in(text: Column, parts: list[str]) -> Column:
    """Whether a text contains one of some strings."""
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def topics(text: Column) -> Column:
    """The topics that a text mentions, in fixed order."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(any_in(low, parts), F.lit(name)) for name, parts in TOPICS)))


def question_type(text: Column) -> Column:
    low, found = F.lower(text), F.lit("general")
    for name, parts in reversed(QUESTION_TYPES):
        found = F.when(any_in(low, parts), name).otherwise(found)
    return found


def asks_for_variables(text: Column) -> Column:
    """Whether a question asks which variables there are."""
    low = F.lower(text)
    return low.rlike(r"(what|which|list|show).{0,40}variables") | (low.contains("variables") & (low.contains("available") | low.contains("list")))


def slugify(text: Column, most: int = 60) -> Column:
    """Lower case; runs of anything but ASCII letters and digits become one underscore; none at the ends, also after the cut; export where nothing is left."""
    plain = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.rtrim(F.when(plain == "", "export").otherwise(F.left(plain, F.lit(most))), F.lit("_"))


def is_variable_name(text: Column) -> Column:
    return F.coalesce(text.rlike("^[A-Za-z][A-Za-z0-9_]{0,59}$"), F.lit(False))


def years(text: Column) -> Column:
    """Struct of first and last year: of a written range, else of all years from 1900 to 2099; null without any."""
    span = r"(?i)\b((?:19|20)\d\d)\s*(?:-|\x{2013}|\x{2014}|to|a\x{17E}|a\x{17C}|do)\s*((?:19|20)\d\d)\b"
    a, b = (F.nullif(F.regexp_extract(text, span, i), F.lit("")).cast("int") for i in (1, 2))
    every = F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d\d)\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.struct(F.coalesce(F.least(a, b), F.array_min(every)).alias("first"), F.coalesce(F.greatest(a, b), F.array_max(every)).alias("last"))


def url_path(url: Column) -> Column:
    """The path of a URL, without query and fragment."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def url_format(url: Column) -> Column:
    """The format that a URL's path names: by a compound suffix, else by the last path segment with a known one, else unknown."""
    path = F.lower(url_path(url))
    suffix = lambda s: F.regexp_extract(s, r"[^.](\.[^.]+)$", 1)
    table = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    segments = F.transform(F.reverse(F.split(path, "/")), lambda s: table[suffix(s)])
    return F.when(path.rlike(r"\.(nc|tar)\.gz$"), "gz").otherwise(F.coalesce(F.get(F.array_compact(segments), F.lit(0)), F.lit("unknown")))


def magic_format(content: Column) -> Column:
    """The format of a file by its first bytes; null where they are too few or unknown."""
    head = F.hex(F.substring(content, 1, 8))
    found = F.when(head.startswith("434446"), "netcdf").when(head.startswith("89484446"), "hdf5").when(head.startswith("47524942"), "grib")
    found = found.when(head.startswith("49492A00") | head.startswith("4D4D002A"), "geotiff").when(head.startswith("1F8B"), "gzip")
    return F.when(F.length(content) >= 4, found)


def is_html(content: Column) -> Column:
    """Whether a file's first 512 bytes hold HTML tags."""
    return F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1")).rlike("<!doctype html|<html|<head|<body")


def dataset_name(url: Column) -> Column:
    """A title from the last path segment without its suffix: separators become blanks."""
    last = F.element_at(F.filter(F.split(url_path(url), "/"), lambda s: s != ""), -1)
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(last, r"\.[A-Za-z0-9]+$", ""), "[-_.]+", " ")))


def source_id(name: Column, row: Column) -> Column:
    """A catalog entry's id from its name and row."""
    return F.concat(F.lit("catalog_"), F.translate(name, " /()", "_-"), F.lit("_"), row.cast("string"))


def catalog_variable(hazard: Column) -> Column:
    return F.concat(F.lit("catalog_"), F.lower(F.replace(F.coalesce(hazard, F.lit("general")), F.lit(" "), F.lit("_"))))


def clean(value: Column) -> Column:
    """Without blanks around it; null where nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def masked(secret: Column) -> Column:
    """The first four and last three characters of a longer secret."""
    return F.when(F.char_length(secret) > 10, F.concat(F.left(secret, F.lit(4)), F.lit("..."), F.right(secret, F.lit(3)))).otherwise(F.lit("***"))


def inclusive_days(start: Column, end: Column) -> Column:
    """Days from start to end, both included."""
    return F.datediff(end.cast("date"), start.cast("date")) + 1


def chunk_text(dataset: Column, variable: Column, unit: Column, hazard: Column, start: Column, end: Column, mean: Column, low: Column, high: Column) -> Column:
    """A chunk's description in sentences; parts without a value vanish."""
    number = lambda c: F.format_string("%.2f", c.cast("double"))
    opener = F.concat(dataset, F.lit(" - "), F.replace(variable, F.lit("_"), F.lit(" ")), F.coalesce(F.concat(F.lit(" in "), unit), F.lit("")))
    context = F.concat(F.lit("Climate hazard context: "), F.replace(F.regexp_replace(hazard, "^catalog_", ""), F.lit("_"), F.lit(" ")))
    period = F.concat(F.lit("Period: "), start, F.lit(" to "), end, F.lit(" ("), inclusive_days(start, end).cast("string"), F.lit(" days)"))
    statistics = F.concat(F.lit("Statistics: mean "), number(mean), F.lit(", range "), number(low), F.lit(" to "), number(high))
    return F.concat_ws(". ", opener, context, period, statistics)
