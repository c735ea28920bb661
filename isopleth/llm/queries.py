"""The registered corpus queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isopleth.llm.linededup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", "text")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isopleth.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isopleth.llm.sstable import token_ids

    return token_ids(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=1)


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isopleth.llm.mixing import score

    return score(_table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isopleth.llm.ngramjoin import near_components

    return near_components(_table(spark, sf_dir, "documents"), percent=90, words=3)


def op6_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isopleth.llm import cotrain

    return cotrain.fit_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isopleth.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isopleth.llm.warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages"), least_bytes=0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isopleth.llm import quality

    docs = _table(spark, sf_dir, "documents")
    return quality.apply_rules(docs, quality.fit_field(docs, _table(spark, sf_dir, "labels")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from isopleth.llm.bytebpe import digest_bpe

    return digest_bpe(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isopleth.llm.divergence import divergence

    return divergence(_table(spark, sf_dir, "documents"))


def op12_even_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isopleth.llm.evenpack import pack_even

    return pack_even(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isopleth.llm.prefixtrie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
filled AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
summed AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n) OVER (PARTITION BY lang, term) AS n_lang, sum(n) OVER (PARTITION BY lang) AS total_lang, count(*) OVER (PARTITION BY lang, source) AS v FROM filled),
shares AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // (total + 2 * v) AS p, 1 + 1000000000 * (n_lang + 2) // (total_lang + 2 * v) AS q FROM summed),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP13_SQL = r"""
WITH bytes AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY i) AS remainders FROM range(256) AS r(i)),
turns AS (SELECT conv_id, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM turns),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda x, b: xor(x >> 8, remainders[(xor(x, b) & 255) + 1])), 4294967295) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), bytes),
rebuilt AS (
    SELECT c.conv_id, p.place, p.digest, p.words FROM convs c JOIN placed p ON p.conv_id = c.base AND p.place <= c.h
    UNION ALL SELECT c.conv_id, p.place, p.digest, p.words FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.place > c.h),
numbered AS (SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth FROM rebuilt),
paths AS (
    SELECT conv_id, 0 AS depth, '' AS path, '' AS above, 0 AS words FROM convs
    UNION ALL SELECT conv_id, depth, string_agg(digest, '') OVER w, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), words FROM numbered WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path),
nodes AS (SELECT path, any_value(above) AS above, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM paths GROUP BY path),
children AS (SELECT above AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
below AS (SELECT a.path, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved_tokens
    FROM nodes a JOIN nodes b ON starts_with(b.path, a.path) LEFT JOIN children c ON c.path = b.path GROUP BY a.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN nodes up ON n.depth > 0 AND up.path = n.above LEFT JOIN children c ON c.path = n.path LEFT JOIN ends e ON e.path = n.path
"""


def queries() -> dict:
    return {name: run for name, run in globals().items() if name.startswith("op") and callable(run)}


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": OP11_SQL, "op13_prefix_trie": OP13_SQL}
