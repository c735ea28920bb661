"""The flagship plan: questions to ranked chunks, and the prompt or the plain summary that answers from them."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isopleth.functions import descriptions, models, texts
from isopleth.operators import retrieve
from isopleth.plans.registry import register
from isopleth.sources.scratch import folder


def search(questions: DataFrame, chunks: DataFrame, top_k: int = 10, embed: models.Embed = models.hashed_embedding) -> DataFrame:
    """query_id, question and its top_k chunks: nearest by vector, quotas by source and variable, marginal relevance, rank from 1.

    questions: query_id, question. chunks: id, text, source, variable, dataset, is_summary, embedding.
    """
    asked = questions.withColumn("embedding", models.embedded(F.col("question"), embed))
    hits = retrieve.knn(asked, chunks, 60, ["source", "variable", "dataset", "is_summary"]).drop("rank")
    kept = retrieve.mmr(retrieve.diversity_quota(hits), 2 * top_k).where(F.col("mmr_rank") <= top_k)
    return kept.select("query_id", "id", "score", "source", "variable", F.col("mmr_rank").alias("rank")).join(questions, "query_id")


#: Lists of a search: the question's own, the same by dataset, up to 98 wordings, then topics.
OWN, GROUPED, VARIANT, TOPIC = 0, 1, 2, 100
WEIGHTS = {OWN: 1.0, GROUPED: 1.0, **{n: 0.6 for n in range(VARIANT, TOPIC)}, **{n: 0.9 for n in range(TOPIC, TOPIC + 20)}}
KEEP = ["source", "variable", "dataset", "is_summary"]


def ranked_lists(questions: DataFrame, chunks: DataFrame, variants: DataFrame | None = None, embed: models.Embed = models.hashed_embedding) -> DataFrame:
    """The ranked lists of each question: query_id, list_id, id, score, rank, KEEP, topics (how many the question has).

    60 hits of the question, the same grouped by dataset (two of each of the best fifteen), 20 of each other wording
    and, where there are several, of each topic. All are searched at once.
    """
    found = texts.topics(F.col("question"))
    own = questions.select("query_id", F.lit(OWN).alias("list_id"), F.col("question").alias("text"))
    topics = questions.select("query_id", F.posexplode(descriptions.topic_queries(found)).alias("n", "text")).select("query_id", (TOPIC + F.col("n")).alias("list_id"), "text")
    asked = own.unionByName(topics)
    if variants is not None:
        asked = asked.unionByName(variants.select("query_id", (F.col("n") + VARIANT - 1).cast("int").alias("list_id"), "text"))
    # a search has a number of its own, and its list is told apart again afterwards
    asked = asked.withColumn("search", F.concat_ws(":", F.col("query_id").cast("string"), F.col("list_id").cast("string"))).withColumn("embedding", models.embedded(F.col("text"), embed))
    hits = retrieve.knn(asked, chunks, 60, KEEP, query_id="search").withColumnRenamed("query_id", "search")
    lists = hits.join(asked.select("search", "query_id", "list_id"), "search").drop("search").where((F.col("list_id") == OWN) | (F.col("rank") <= 20))
    # what follows reads the lists several times: they are written, so that chunks are embedded and compared once
    path = folder(questions.sparkSession, "lists")
    lists.write.parquet(path)
    lists = questions.sparkSession.read.schema(lists.schema).parquet(path)
    grouped = retrieve.grouped_list(lists.where(F.col("list_id") == OWN)).withColumn("list_id", F.lit(GROUPED))
    return lists.unionByName(grouped).join(questions.select("query_id", F.size(found).alias("topics")), "query_id")


def search_all(questions: DataFrame, chunks: DataFrame, variants: DataFrame | None = None, top_k: int = 10, embed: models.Embed = models.hashed_embedding, rerank: models.Rerank | None = None) -> DataFrame:
    """The whole plan: query_id, id, score, source, variable, rank.

    1. The question, its variants (query_id, n, text) and a text per topic where it has several are searched at once.
    2. Their lists are fused, the question's own ones with full weight, variants with 0.6, topics with 0.9.
    3. Where there are several topics data go before summaries; quotas by source and variable; sources are filled up to four,
       and at least three are guaranteed (see retrieve.chosen_order).
    4. The best are put in order again by a model that reads question and chunk together, where one is given.
    5. Marginal relevance picks the last list.
    """
    lists = ranked_lists(questions, chunks, variants, embed)
    chosen = retrieve.chosen_order(lists, WEIGHTS, F.col("topics") > 1)
    if rerank:
        read = chosen.where(F.col("place") <= 5 * top_k).join(chunks.select("id", "text"), "id").join(questions, "query_id")
        read = read.withColumn("again", models.reranked(F.col("question"), F.col("text"), rerank)).drop("text", "question")
        order = Window.partitionBy("query_id").orderBy(F.desc("again"), "place")
        chosen = read.withColumn("place", F.row_number().over(order)).drop("again").where(F.col("place") <= 3 * top_k)
    picked = retrieve.mmr(chosen, 2 * top_k, order="place").where(F.col("mmr_rank") <= top_k)
    return picked.select("query_id", "id", "score", "source", "variable", F.col("mmr_rank").alias("rank"))


def rewritten(found: DataFrame, questions: DataFrame, chunks: DataFrame, generate: models.Generate) -> DataFrame:
    """query_id, question: other words for weak questions whose first five chunks a model finds insufficient.

    A wording of up to ten characters, or the question itself again, is none; without an answer nothing is asked again.
    """
    shown = found.where(F.col("rank") <= 5).join(chunks.select("id", "text"), "id")
    line = F.concat(F.lit("- "), "source", F.lit("/"), "variable", F.lit(": "), F.left("text", F.lit(120)))
    listed = shown.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    weak = weak_questions(found).select("query_id").join(questions, "query_id").join(listed, "query_id")
    grade = F.udf(lambda q, lines: generate(f"Question: {q}\nRetrieved:\n{lines}\nIs this sufficient or insufficient to answer it? Answer in one word."), "string")
    ask = F.udf(lambda q: generate(f"This search found nothing of use:\n{q}\nWrite one better search, with names of variables and datasets, and nothing else."), "string")
    bad = weak.where(F.lower(grade("question", "lines")).contains("insufficient"))
    new = bad.withColumn("new", F.trim(ask("question"), F.lit("\"' \n")))
    return new.where((F.char_length("new") > 10) & (F.lower("new") != F.lower("question"))).select("query_id", F.col("new").alias("question"))


def search_with_retry(questions: DataFrame, chunks: DataFrame, generate: models.Generate, variants: DataFrame | None = None, top_k: int = 10, embed: models.Embed = models.hashed_embedding, rerank: models.Rerank = models.lexical_overlap) -> DataFrame:
    """search_all, and for weak questions once more in other words: of 40 hits the first 30 are read again by a model, and
    those that it gives 0.1 or more join the list, if their source and variable are new."""
    found = search_all(questions, chunks, variants, top_k, embed)
    again = rewritten(found, questions, chunks, generate)
    hits = retrieve.knn(again.withColumn("embedding", models.embedded(F.col("question"), embed)), chunks, 40, ["source", "variable"]).where(F.col("rank") <= 30)
    read = hits.join(chunks.select("id", "text"), "id").join(again, "query_id").withColumn("score", models.reranked(F.col("question"), F.col("text"), rerank)).where(F.col("score") >= 0.1)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return with_retry(found, read.withColumn("rank", F.row_number().over(order)).select(*found.columns))


def with_retry(found: DataFrame, again: DataFrame) -> DataFrame:
    """found, and of a second search the first hit of each (source, variable) that the first lacks, ranked behind it."""
    pair = ["query_id", "source", "variable"]
    new = again.join(found.select(*pair).distinct(), pair, "left_anti").withColumn("p", F.row_number().over(Window.partitionBy(*pair).orderBy("rank", "id"))).where("p = 1")
    last = found.groupBy("query_id").agg(F.max("rank").alias("last"))
    placed = new.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))).join(last, "query_id", "left")
    return found.unionByName(placed.withColumn("rank", (F.coalesce("last", F.lit(0)) + F.col("r")).cast("int")).select(*found.columns))


def expanded(questions: DataFrame, generate: models.Generate, most: int = 3) -> DataFrame:
    """Up to `most` other wordings of each question, as a model writes them line by line; lines of up to ten characters are no wordings."""
    answer = F.udf(lambda q: generate(f"Write {most} other wordings of this question, one on each line:\n{q}"), "string")
    lines = F.filter(F.transform(F.split(answer("question"), "\n"), lambda x: F.trim(x)), lambda line: F.char_length(line) > 10)
    return questions.select("query_id", F.posexplode(F.slice(lines, 1, most)).alias("n", "text")).select("query_id", (F.col("n") + 1).alias("n"), "text")


def prompts(found: DataFrame, chunks: DataFrame, most: int = 15) -> DataFrame:
    """One prompt per question: its type, its topics and at most `most` chunks as documents with their scores."""
    documents = found.where(F.col("rank") <= most).join(chunks.select("id", "text"), "id")
    one = F.concat(F.lit('<document rank="'), "rank", F.lit('" score="'), F.format_string("%.3f", "score"), F.lit('" source="'), "source", F.lit('">\n'), "text", F.lit("\n</document>"))
    listed = documents.groupBy("query_id", "question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("d")))), lambda x: x["d"]), "\n").alias("documents"))
    kind, topics = texts.question_type(F.col("question")), F.array_join(texts.topics(F.col("question")), ", ")
    return listed.select("query_id", "question", F.concat_ws("\n", F.concat(F.lit("Question type: "), kind), F.concat(F.lit("Topics: "), topics), "documents", F.concat(F.lit("Question: "), "question")).alias("prompt"))


def plain_answers(found: DataFrame, chunks: DataFrame, most: int = 5) -> DataFrame:
    """The answer without a model: the first chunks' openings as a list."""
    documents = found.where(F.col("rank") <= most).join(chunks.select("id", "text"), "id")
    line = F.concat(F.lit("- "), "source", F.lit(": "), F.left("text", F.lit(200)))
    return documents.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("answer"))


def weak_questions(found: DataFrame, least: int = 3, score: float = 0.2) -> DataFrame:
    """Questions whose answer rests on too few chunks or a first one that is too distant, to be asked again in other words."""
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.min_by("score", "rank").alias("best")).where((F.col("n") < least) | (F.col("best") < score))


def _asked(spark, sf_dir):
    """The first turn of every 50th conversation is a question, documents are chunks."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id % 50 = 0")
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    questions = turns.withColumn("n", first).where("n = 1").select(F.col("conv_id").alias("query_id"), F.col("text").alias("question"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chunks = docs.select(
        F.col("doc_id").alias("id"), "text", "source", F.col("lang").alias("variable"), F.concat(F.lit("d"), F.col("doc_id") % 7).alias("dataset"), (F.col("doc_id") % 11 == 0).alias("is_summary"), models.embedded(F.col("text")).alias("embedding")
    )
    return questions, chunks


def dataset_contexts(entries: DataFrame, generate: models.Generate) -> DataFrame:
    """entries with a context that a model writes once for each dataset name."""
    write = F.udf(lambda name: generate(f"Describe the dataset {name} in two sentences."), "string")
    # the model is asked in one place for each name, and not again for each entry
    names = entries.select("dataset_name").where("dataset_name is not null").distinct().withColumn("context", write("dataset_name"))
    return entries.join(names, "dataset_name", "left")


@register("rag_search")
def rag_search(spark, sf_dir):
    """The short plan over documents; rows only, as models have no SQL twin."""
    return search(*_asked(spark, sf_dir)).select("query_id", "id", "score", "source", "variable", "rank")


@register("rag_search_all")
def rag_search_all(spark, sf_dir):
    """The whole plan over documents; rows only."""
    return search_all(*_asked(spark, sf_dir))
