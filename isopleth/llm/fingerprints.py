"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest 48-bit hashes of a text's distinct shingles of five words (ASCII letters in lower case);
a text of fewer words has its whole sequence as its one shingle, a text without words none. Sketches of parts merge
into the sketch of the union of their shingles. As text, a sketch is base64 of its hashes in ascending order, six
big-endian bytes each.
"""

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.llm.common import ODD_SPACE, WORD, Rows, shuffle_partitions, text_or_empty

K, WORDS, SPACE = 256, 5, 1 << 48
_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = re.compile(WORD)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: str) -> list[str]:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    text = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).decode("utf-8", "surrogatepass")
    return _WORD.findall(text) if ODD_SPACE.search(text) else text.split()


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgets all beyond a bound."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the shingles of n words, repeats included; the whole sequence where there are fewer words."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    total = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        total += mix(hashes[i : len(hashes) - n + 1 + i] + np.uint64(i)) * _MULTIPLIERS[i]
    return mix(total)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct shingle hashes, as 48-bit numbers."""
    values = shingles(hashes, WORDS) >> np.uint64(16)
    if len(values) > 4 * k:  # sort a low part alone if it has enough distinct values
        take = 2 * k
        while take < len(values):
            low = np.unique(np.partition(values, take)[:take])
            if len(low) > k:
                return low[:k]
            take *= 4
    return np.unique(values)[:k]


def to_text(values: np.ndarray) -> str:
    return base64.b64encode(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets; exact when both have at most k shingles together. Two empty: 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    same = both[1:] == both[:-1]
    distinct = np.concatenate([[True], ~same])
    rank = np.cumsum(distinct)
    most = min(k, int(rank[-1]))
    return float(np.count_nonzero(same & (rank[1:] <= most)) / most)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1]) / SPACE)


def union(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate([a, b]))[:k]


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too. An empty a is contained in anything."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(union(a, b, k), k) / distinct_count(a, k))


def fingerprint(text_col: str = "text") -> Column:
    """Column of fingerprints of whole texts (missing: empty)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = WordHashes()
        for texts in batches:
            yield texts.map(lambda t: to_text(sketch(memo.of(words_of(t)))))

    return run(text_or_empty(text_col))


def merge_fingerprints(df: DataFrame, key: str, fingerprint_col: str = "fingerprint", k: int = K, salts: int = 64) -> DataFrame:
    """One fingerprint per key from those of its parts: (key, fingerprint).

    Hashes are first cut to the k smallest distinct per key and salt, then per key, so no task holds a large key's
    parts. Missing fingerprints count as empty; a missing key is a group of its own.
    """

    @F.pandas_udf("array<long>")
    def unpack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: from_text(t).astype(np.int64))

    @F.pandas_udf("string")
    def repack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: to_text(np.sort(np.asarray(v, np.uint64))))

    parts = df.select(F.col(key).alias("key"), F.coalesce(fingerprint_col, F.lit("")).alias("f"))
    hashes = parts.select("key", F.explode(unpack("f")).alias("h")).withColumn("salt", F.pmod(F.col("h"), F.lit(salts)))
    per_salt = hashes.dropDuplicates(["key", "salt", "h"]).withColumn("r", F.row_number().over(Window.partitionBy("key", "salt").orderBy("h"))).where(F.col("r") <= k)
    per_key = per_salt.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("h"))).where(F.col("r") <= k)
    merged = per_key.groupBy("key").agg(F.collect_list("h").alias("h")).select("key", repack("h").alias("fingerprint"))
    empty = parts.select("key").distinct()
    return empty.join(merged, empty["key"].eqNullSafe(merged["key"]), "left").select(empty["key"].alias(key), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_shingles_est", pa.float64()), ("contained_in_edited", pa.float64())])


def with_next(docs: DataFrame, visit, out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hands each document and the next one, by ascending identifier and then text, to visit(id, text, next_text) in a stream.

    After the last document comes the first. Documents go to parts by ranges of the identifier; the first document of
    a part also goes to the part before, so texts are shuffled once and neighbours never cross tasks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    n = shuffle_partitions(spark)
    cuts = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 20000).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    n = len(cuts) + 1

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        missing = ids.isna().to_numpy()
        found = np.searchsorted(np.array(cuts, np.int64), ids.fillna(0).astype("int64").to_numpy(), side="right")
        return pd.Series(np.where(missing, 0, found).astype("int32"))

    firsts = sorted((r.part, r.low is not None, r.low or 0) for r in rows.select("id", part_of("id").alias("part")).groupBy("part").agg(F.min(F.struct("id"))["id"].alias("low")).collect())
    before = {key[1:]: firsts[i - 1][0] for i, key in enumerate(firsts)}  # the first part's documents follow the last part's
    heads = spark.createDataFrame([(low if there else None, part) for (there, low), part in before.items()], "head long, to int")
    main = rows.withColumn("part", part_of("id")).withColumn("sentinel", F.lit(False))
    extra = rows.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("head"))).select("id", "text", F.col("to").alias("part"), F.lit(True).alias("sentinel"))
    dealt = main.unionByName(extra).repartitionById(n, "part").sortWithinPartitions("sentinel", "id", "text")

    def run(batches):
        last, over, rows_out = None, False, Rows(OUT, 250)
        for batch in batches:
            for key, text, sentinel in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "sentinel"))):
                if over:
                    continue
                if last is not None:
                    rows_out.add(*visit(*last, text))
                last, over = (key, text), sentinel
                if rows_out.full():
                    yield rows_out.take()
        yield rows_out.take()

    return dealt.mapInArrow(run, out)


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the next text."""
    q = len(text) // 4
    return text[: len(text) - q] + after[:q]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, with likeness to the edited and to the next text.

    Missing texts count as empty; equal identifiers are ordered by text; missing identifiers come first; an empty
    table gives no rows; other columns are ignored.
    """
    state = {}

    def visit(key, text, after):
        memo = state.setdefault("memo", WordHashes())
        own = state["sketch"] if state.get("text") is text else sketch(memo.of(words_of(text)))
        state["text"], state["sketch"] = after, sketch(memo.of(words_of(after)))
        changed = edited(text, after)
        other = sketch(memo.of(words_of(changed)))
        sha = hashlib.sha256(changed.encode("utf-8")).hexdigest()
        return key, len(text), sha, to_text(own), to_text(other), resemblance(own, other), resemblance(own, state["sketch"]), distinct_count(own), containment(own, other)

    return with_next(docs, visit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles_est double, contained_in_edited double")
