"""Scores of retrieved chunks and answers, as column expressions over arrays: one row per question, no pairs.

contexts are lower-case strings, each a chunk's text and metadata. Scores are rounded to three places and are 0 where
there are no chunks or no answer.
"""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of which any member stands for any other of its group.
ALIASES = [
    ["era5", "c3s", "copernicus", "copernicus climate", "cerra", "era5-heat", "era5 land"],
    ["cams", "copernicus atmosphere"],
    ["copernicus marine", "cmems", "sst_med", "hadlsst", "sst"],
    ["grace", "grace-fo", "jpl grace", "jpl_grace"],
    ["imerg", "gpm", "gpm-imerg"],
    ["merra-2", "merra2", "merra", "merra2_aerosol"],
    ["e-obs", "eobs", "cy-obs"],
    ["spei", "speibase", "spei-gd", "spi"],
]
# Phrases by which an answer hedges; common words that prove nothing.
HEDGES = ["i don't have", "no data", "cannot determine", "insufficient", "not available"]
COMMON = ["which", "where", "about", "these", "those", "their", "there", "would", "could", "should", "other", "between", "during"]
# Fixed value: kelvins at zero degrees Celsius.
ZERO_CELSIUS = 273.15
NUMBER = r"\d+\.?\d*"


@F.pandas_udf(T.StringType())
def nfkd(texts: pd.Series) -> pd.Series:
    """Texts in compatibility decomposition (subscripts become digits); Spark has no such function."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def contexts(texts: Column, metas: Column) -> Column:
    """Each chunk's text and metadata in lower case."""
    return F.zip_with(texts, metas, lambda t, m: F.lower(F.concat(F.coalesce(t, F.lit("")), F.lit(" "), F.coalesce(m, F.lit("")))))


def _share(part: Column, whole: Column, of_none: float) -> Column:
    return F.when(F.size(whole) == 0, F.lit(of_none)).otherwise(F.size(part) / F.size(whole))


def _any_of(text: Column, parts: Column) -> Column:
    return F.exists(parts, lambda p: F.contains(text, F.lower(p)))


def _facts(text: Column, facts: Column) -> Column:
    """The share of facts that a text has; 1 where there are none."""
    return _share(F.filter(facts, lambda f: F.contains(text, F.lower(f))), facts, 1.0)


def context_relevance(found: Column, facts: Column, markers: Column) -> Column:
    """0.6 of the share of facts found anywhere, 0.4 of the share of chunks that are not about irrelevant things alone."""
    relevant = F.filter(found, lambda c: _any_of(c, facts) | ~_any_of(c, markers))
    score = 0.6 * _facts(F.array_join(found, " "), facts) + 0.4 * _share(relevant, found, 0.0)
    return F.when(F.size(found) == 0, F.lit(0.0)).otherwise(F.round(score, 3))


def numbers(text: Column) -> Column:
    """The distinct numbers written in a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def number_grounding(answer: Column, context: Column) -> Column:
    """The share of an answer's telling numbers that a context has, within 3 % or as the same temperature; 1 without any.

    Numbers of one or two characters and years say nothing.
    """
    known = F.transform(numbers(context), lambda n: n.cast("double"))
    known = F.flatten(F.transform(known, lambda v: F.array_compact(F.array(v, F.when((v > 200) & (v < 330), v - ZERO_CELSIUS), F.when((v > -100) & (v < 60), v + ZERO_CELSIUS)))))
    telling = F.filter(numbers(answer), lambda n: (F.length(n) > 2) & ~(n.cast("double").between(1900, 2099) & ~F.contains(n, F.lit("."))))
    near = lambda n: F.exists(known, lambda v: F.abs(v - n.cast("double")) / F.greatest(F.abs(n.cast("double")), F.lit(0.01)) < 0.03)
    return _share(F.filter(telling, lambda n: F.contains(context, n) | near(n)), telling, 1.0)


def faithfulness(answer: Column, found: Column) -> Column:
    """0.6 of the grounding of numbers and 0.4; an answer that hedges gets 0.9 of that, 0.7 at least."""
    base = 0.6 * number_grounding(answer, F.array_join(found, " ")) + 0.4
    hedges = F.exists(F.array(*map(F.lit, HEDGES)), lambda p: F.contains(F.lower(answer), p))
    score = F.when(hedges, F.greatest(0.9 * base, F.lit(0.7))).otherwise(base)
    return F.when((F.size(found) == 0) | (F.coalesce(answer, F.lit("")) == ""), F.lit(0.0)).otherwise(F.round(score, 3))


def correctness(answer: Column, facts: Column, truth: Column, decomposed: Column | None = None) -> Column:
    """0.7 of the share of facts in the answer, 0.3 of the telling words of the true answer in it. decomposed: a column that holds the answer by nfkd (a Python function can't stand within the lambdas here)."""
    low = F.lower(answer)
    other = low if decomposed is None else F.lower(decomposed)
    there = lambda part: F.contains(low, part) | F.contains(other, part)
    words = F.filter(F.split(truth, r"\s+"), lambda w: (F.char_length(w) > 4) & ~F.lower(w).isin(COMMON))
    words = F.array_distinct(F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(".,;:()[]")))))
    score = 0.7 * _share(F.filter(facts, lambda f: there(F.lower(f))), facts, 1.0) + 0.3 * _share(F.filter(words, there), words, 0.0)
    return F.when(F.coalesce(answer, F.lit("")) == "", F.lit(0.0)).otherwise(F.round(score, 3))


def diversity(names: Column) -> Column:
    """By the number of sources among chunks, less a fifth where one has more than three fifths of them."""
    each = F.array_distinct(names)
    most = F.array_max(F.transform(each, lambda e: F.size(F.filter(names, lambda n: n == e))))
    steps = F.when(F.size(each) >= 5, 1.0).when(F.size(each) == 4, 0.85).when(F.size(each) == 3, 0.7).when(F.size(each) == 2, 0.5).otherwise(0.2)
    return F.when(F.size(names) == 0, F.lit(0.0)).otherwise(F.round(steps * F.when(most / F.size(names) > 0.6, 0.8).otherwise(1.0), 3))


def precision_at(found: Column, facts: Column, k: int = 5) -> Column:
    """The share of the first k chunks that have a fact."""
    top = F.slice(found, 1, k)
    return F.round(_share(F.filter(top, lambda c: _any_of(c, facts)), top, 0.0), 3)


def composite(relevance: Column, faith: Column, correct: Column, precision: Column) -> Column:
    return relevance * 0.30 + faith * 0.25 + correct * 0.30 + precision * 0.15


def status(score: Column, least: float = 0.5) -> Column:
    return F.when(score >= least, "PASS").otherwise("FAIL")


def first_score(datasets: Column, in_chunks: Column, in_answer: Column) -> Column:
    """The earlier weighting: with an answer 0.35, 0.30, 0.35, without one 0.55 and 0.45."""
    return F.when(in_answer.isNull(), datasets * 0.55 + in_chunks * 0.45).otherwise(datasets * 0.35 + in_chunks * 0.30 + in_answer * 0.35)


def number_coverage(answer: Column, wanted: Column) -> Column:
    """The share of wanted numbers that an answer writes the same way; 1 without any."""
    own = numbers(answer)
    return _share(F.filter(wanted, lambda w: F.array_contains(own, w)), wanted, 1.0)


def dataset_hits(found: Column, expected: Column) -> Column:
    """The expected datasets that chunks name, by their own name or by an alias of the first group that has it."""
    text = F.array_join(found, " ")
    groups = F.array(*(F.array(*map(F.lit, group)) for group in ALIASES))

    def hit(name: Column) -> Column:
        group = F.get(F.filter(groups, lambda g: F.array_contains(g, F.lower(name))), F.lit(0))
        return F.contains(text, F.lower(name)) | F.coalesce(F.exists(group, lambda alias: F.contains(text, alias)), F.lit(False))

    return F.filter(expected, hit)


def by_category(results: DataFrame, category: str = "category") -> DataFrame:
    """Average composite, passes and count per category."""
    return results.groupBy(category).agg(F.avg("composite").alias("composite"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count("*").alias("n"))
