"""Registered queries of evaluation scores: conversations as cases, their turns as retrieved chunks."""

from pyspark.sql import functions as F

from isopleth.operators import scores
from isopleth.plans.registry import register

NAMES = ["ERA5", "GRACE", "CRU TS", "ERA5", "E-OBS"]

CASES = f"""cases AS (SELECT conv_id, texts, names, list_transform(list_zip(texts, names), lambda x: lower(x[1] || ' ' || x[2])) AS found, texts[-1] AS answer, string_split(texts[1], ' ')[1:3] AS facts
 FROM (SELECT conv_id, list(text ORDER BY turn, role, text) AS texts, list({NAMES}[turn % 5 + 1] ORDER BY turn, role, text) AS names FROM conversations WHERE text IS NOT NULL GROUP BY conv_id))"""


def _cases(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null")
    cases = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    name = lambda t: F.element_at(F.array(*map(F.lit, NAMES)), (t["turn"] % 5 + 1).cast("int"))
    cases = cases.select("conv_id", F.transform("turns", lambda t: t["text"]).alias("texts"), F.transform("turns", name).alias("names"))
    found = scores.contexts(F.col("texts"), F.col("names"))
    return cases.select("*", found.alias("found"), F.element_at("texts", -1).alias("answer"), F.slice(F.split(F.element_at("texts", 1), " "), 1, 3).alias("facts"))


def _list(values):
    return F.array(*map(F.lit, values))


RELEVANCE = """round(0.6 * (CASE WHEN len(facts) = 0 THEN 1.0 ELSE len(list_filter(facts, lambda f: contains(array_to_string(found, ' '), lower(f)))) / len(facts) END)
 + 0.4 * len(list_filter(found, lambda c: len(list_filter(facts, lambda f: contains(c, lower(f)))) > 0 OR NOT (contains(c, 'please') OR contains(c, 'der ')))) / len(found), 3)"""


@register("context_relevance", f"WITH {CASES} SELECT conv_id, {RELEVANCE} AS score FROM cases")
def context_relevance(spark, sf_dir):
    """Facts found, and chunks that are not irrelevant."""
    return _cases(spark, sf_dir).select("conv_id", scores.context_relevance(F.col("found"), F.col("facts"), _list(["please", "der "])).alias("score"))


NUMBERS = "list_distinct(regexp_extract_all({}, '\\d+\\.?\\d*'))"
TRUTH = "'In 1995 about 421.6 units, or 12.5 and 272.82 and 2001.5; 33'"
FAITH = f"""WITH {CASES}, noted AS (SELECT conv_id, found, answer || ' ' || {TRUTH} AS answer, array_to_string(found, ' ') || CASE conv_id % 3 WHEN 0 THEN ' 422 -0.3' WHEN 1 THEN ' 285.65 no data 12.5' ELSE '' END AS context, conv_id % 4 = 0 AS hedged FROM cases),
 known AS (SELECT *, list_filter(flatten(list_transform(list_transform({NUMBERS.format('context')}, lambda n: CAST(n AS DOUBLE)), lambda v: [v, CASE WHEN v > 200 AND v < 330 THEN v - 273.15 END, CASE WHEN v > -100 AND v < 60 THEN v + 273.15 END])), lambda v: v IS NOT NULL) AS floats,
 list_filter({NUMBERS.format('answer')}, lambda n: length(n) > 2 AND NOT (CAST(n AS DOUBLE) BETWEEN 1900 AND 2099 AND NOT contains(n, '.'))) AS telling FROM noted),
 base AS (SELECT conv_id, hedged, 0.6 * (CASE WHEN len(telling) = 0 THEN 1.0 ELSE len(list_filter(telling, lambda n: contains(context, n) OR len(list_filter(floats, lambda v: abs(v - CAST(n AS DOUBLE)) / greatest(abs(CAST(n AS DOUBLE)), 0.01) < 0.03)) > 0)) / len(telling) END) + 0.4 AS b,
 list_bool_or([contains(lower(answer || CASE WHEN hedged THEN ' Insufficient' ELSE '' END), p) FOR p IN {[h.replace(chr(39), chr(39) * 2) for h in scores.HEDGES if chr(39) not in h]}]) OR contains(lower(answer), 'i don''t have') AS hedges FROM known)"""


@register("faithfulness", f"{FAITH} SELECT conv_id, round(CASE WHEN hedges THEN greatest(0.9 * b, 0.7) ELSE b END, 3) AS score FROM base")
def faithfulness(spark, sf_dir):
    """Numbers of an answer that the chunks ground."""
    cases, third = _cases(spark, sf_dir), F.col("conv_id") % 3
    more = F.when(third == 0, " 422 -0.3").when(third == 1, " 285.65 no data 12.5").otherwise("")
    hedged = F.when(F.col("conv_id") % 4 == 0, " Insufficient").otherwise("")
    answer = F.concat("answer", F.lit(" " + TRUTH.strip("'")), hedged)
    return cases.select("conv_id", scores.faithfulness(answer, F.concat(F.slice("found", 1, F.size("found") - 1), F.array(F.concat(F.element_at("found", -1), more)))).alias("score"))


WORDS = f"list_distinct(list_transform(list_filter(regexp_split_to_array(truth, '\\s+'), lambda w: length(w) > 4 AND NOT list_contains({scores.COMMON}, lower(w))), lambda w: lower(trim(w, '.,;:()[]'))))"
CORRECT = f"""words AS (SELECT conv_id, lower(answer) AS low, facts, {WORDS} AS words FROM (SELECT *, texts[1] || ' (between), CO2 levels.' AS truth FROM cases)),
 correct AS (SELECT conv_id, round(0.7 * (CASE WHEN len(facts) = 0 THEN 1.0 ELSE len(list_filter(facts, lambda f: contains(low, lower(f)))) / len(facts) END) + 0.3 * (CASE WHEN len(words) = 0 THEN 0.0 ELSE len(list_filter(words, lambda w: contains(low, w))) / len(words) END), 3) AS score FROM words)"""


@register("answer_correctness", f"WITH {CASES}, {CORRECT} SELECT conv_id, score FROM correct")
def answer_correctness(spark, sf_dir):
    """Facts and words of the true answer that an answer has."""
    truth = F.concat(F.element_at("texts", 1), F.lit(" (between), CO2 levels."))
    return _cases(spark, sf_dir).select("conv_id", scores.correctness(F.col("answer"), F.col("facts"), truth).alias("score"))


DIVERSITY = """round(CAST((CASE len(list_distinct(names)) WHEN 1 THEN 0.2 WHEN 2 THEN 0.5 WHEN 3 THEN 0.7 WHEN 4 THEN 0.85 ELSE 1.0 END)
 * (CASE WHEN list_max(list_transform(list_distinct(names), lambda e: len(list_filter(names, lambda n: n = e)))) / len(names) > 0.6 THEN 0.8 ELSE 1.0 END) AS DOUBLE), 3)"""


@register("source_diversity", f"WITH {CASES} SELECT conv_id, {DIVERSITY} AS score FROM cases")
def source_diversity(spark, sf_dir):
    """Sources among a case's chunks."""
    return _cases(spark, sf_dir).select("conv_id", scores.diversity(F.col("names")).alias("score"))


PRECISION = "round(len(list_filter(found[1:5], lambda c: len(list_filter(facts, lambda f: contains(c, lower(f)))) > 0)) / len(found[1:5]), 3)"


@register("precision_at_5", f"WITH {CASES} SELECT conv_id, {PRECISION} AS score FROM cases")
def precision_at_5(spark, sf_dir):
    """The first five chunks that have a fact."""
    return _cases(spark, sf_dir).select("conv_id", scores.precision_at(F.col("found"), F.col("facts")).alias("score"))


@register("composite_by_category", f"""WITH {CASES}, {CORRECT}, scored AS (SELECT conv_id % 7 AS category, {RELEVANCE} * 0.30 + 1.0 * 0.25 + correct.score * 0.30 + {PRECISION} * 0.15 AS composite FROM cases JOIN correct USING (conv_id))
SELECT category, round(avg(composite), 6) AS composite, count(*) FILTER (WHERE composite >= 0.5) AS passed, count(*) AS n FROM scored GROUP BY 1""")
def composite_by_category(spark, sf_dir):
    """The weighted score per category, and how many pass."""
    truth = F.concat(F.element_at("texts", 1), F.lit(" (between), CO2 levels."))
    parts = scores.context_relevance(F.col("found"), F.col("facts"), _list(["please", "der "])), F.lit(1.0), scores.correctness(F.col("answer"), F.col("facts"), truth), scores.precision_at(F.col("found"), F.col("facts"))
    rows = _cases(spark, sf_dir).select((F.col("conv_id") % 7).alias("category"), scores.composite(*parts).alias("composite"))
    return scores.by_category(rows.withColumn("status", scores.status(F.col("composite")))).withColumn("composite", F.round("composite", 6))


EXPECTED = ["C3S", "CERRA", "gpm", "CRU", "nothing"]
HIT = "contains(text, lower(name)) OR coalesce(list_bool_or(list_transform(list_filter({groups}, lambda g: list_contains(g, lower(name)))[1], lambda a: contains(text, a))), FALSE)".format(groups=scores.ALIASES)


@register("dataset_hits", f"""WITH {CASES}, t AS (SELECT conv_id, array_to_string(found, ' ') AS text, len(names) AS n FROM cases), e AS (SELECT conv_id, unnest(range(1, 6)) AS nr, text FROM t), h AS (SELECT conv_id, nr, {EXPECTED}[nr] AS name, text FROM e)
SELECT conv_id, list(name ORDER BY nr) FILTER (WHERE {HIT}) AS found FROM h GROUP BY 1 HAVING count(*) FILTER (WHERE {HIT}) > 0""")
def dataset_hits(spark, sf_dir):
    """The expected datasets that chunks name, also by an alias."""
    found = _cases(spark, sf_dir).select("conv_id", scores.dataset_hits(F.col("found"), _list(EXPECTED)).alias("found"))
    return found.where(F.size("found") > 0)


@register("first_score", f"""WITH {CASES} SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN p * 0.55 + q * 0.45 ELSE p * 0.35 + q * 0.30 + 0.35 * 0.5 END AS score FROM (SELECT conv_id, {PRECISION} AS p, {DIVERSITY} AS q FROM cases)""")
def first_score(spark, sf_dir):
    """The earlier weighting, with and without an answer."""
    answer = F.when(F.col("conv_id") % 5 != 0, 0.5)
    return _cases(spark, sf_dir).select("conv_id", scores.first_score(scores.precision_at(F.col("found"), F.col("facts")), scores.diversity(F.col("names")), answer).alias("score"))


@register("number_coverage", f"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '\\d+\\.?\\d*')) AS own FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(list_filter(['1', '2', '10', '2024', '3.5'], lambda w: list_contains(own, w))) / 5 AS coverage FROM d""")
def number_coverage(spark, sf_dir):
    """The wanted numbers that a text writes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return docs.select("doc_id", scores.number_coverage(F.col("text"), _list(["1", "2", "10", "2024", "3.5"])).alias("coverage"))
