"""Small expressions on numbers, shapes and the answers of models."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from isopleth.operators.scores import ZERO_CELSIUS


def rounded(score: Column, places: int = 3) -> Column:
    """A score to a few places, halves to the even digit."""
    return F.bround(score, places)


def as_celsius(value: Column) -> Column:
    """Kelvins of the earth's surface in degrees Celsius; null for other values."""
    return F.when((value > 200) & (value < 330), value - ZERO_CELSIUS)


def as_kelvin(value: Column) -> Column:
    """Degrees Celsius of the earth's surface in kelvins; null for other values."""
    return F.when((value > -100) & (value < 60), value + ZERO_CELSIUS)


def model_json(answer: Column, schema: str) -> Column:
    """The JSON object that a model wrote, with or without a fence of three backquotes around it; null where it is none."""
    inner = F.when(F.contains(answer, F.lit("```")), F.get(F.split(answer, "```"), F.lit(1))).otherwise(answer)
    plain = F.trim(F.regexp_replace(inner, r"^json", ""))
    return F.when(F.try_parse_json(plain).isNotNull(), F.from_json(plain, schema))


def shape_of(text: Column) -> Column:
    """The whole numbers of a written shape, as (3, 4) or [3, 4]; null where it is no list of numbers."""
    return F.when(text.rlike(r"^\s*[\[(]\s*\d+(\s*,\s*\d+)*\s*,?\s*[\])]\s*$"), F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda d: d.cast("long")))


def merged(base: Column, over: Column) -> Column:
    """A map with another laid over it."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def with_defaults(base: Column, defaults: Column) -> Column:
    """A map with the entries of another under keys that it lacks."""
    return merged(defaults, base)


def duration_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6
