"""The corpus pipeline: quality rules, quality classifier, line dedup, near-duplicate documents, packing.

Each stage takes what its predecessor kept, written as Parquet and read again; all but the last return the columns of
documents. run() does the same in one call. SQL can express neither a line-labelling field nor a tokenizer, so the
pipeline has no SQL twin and is tested against its stages' brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.llm import cotrain, linededup, ngramjoin, packing, quality
from isopleth.llm.common import new_folder


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the line-labelling field keep."""
    return quality.keep_good(docs, quality.fit_field(docs, _labels(spark, sf_dir)))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return cotrain.keep_good(docs, cotrain.fit(docs, _labels(spark, sf_dir)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines, n_chars of what is left; a document of which no line is left goes."""
    left = linededup.dedup_lines(docs).where("n_kept > 0 or n_lines = 0")
    return left.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near-equal ones."""
    return ngramjoin.keep_first(docs, percent=80, words=5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a packed sequence."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("pack", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
