"""Quality classifier by co-training: one view reads the text, the other the page's metadata.

Both views are logistic models. In each round either view labels all unlabelled documents that it is sure of, and the
other view takes one of Newton's steps on the labelled documents and those; slopes and curvatures are summed where the
documents are. At the end each view is calibrated on labelled rows it was not fitted on, the calibrated views are
combined, and every document is scored.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isopleth.llm.common import new_folder, text_or_empty
from isopleth.llm.fingerprints import WordHashes, words_of
from isopleth.llm.linestats import BLANK, BREAK, FEATURES, line_features, line_stats, repeated_lines
from isopleth.llm.quality import repeat_words

WORD_CELLS, LANG_CELLS, SOURCE_CELLS, LENGTH_CELLS = 64, 16, 64, 12
CONTENT = 2 * len(FEATURES) + 1 + WORD_CELLS
METADATA = 1 + LANG_CELLS + SOURCE_CELLS + LENGTH_CELLS


def content_view(text: str, memo: WordHashes) -> np.ndarray:
    """Line features of the whole text and averaged over its lines, share of repeated words, hashed word counts."""
    x = np.zeros(CONTENT, np.float32)
    n = len(FEATURES)
    counts, words, last = line_stats(text)
    solid = counts.sum(1) - counts[:, BLANK] - counts[:, BREAK]
    total = int(solid.sum())
    x[0] = 1
    if total:
        repeated = repeated_lines(text.split("\n"))
        x[:n] = line_features(counts.sum(0, keepdims=True), words.sum(keepdims=True), last[solid > 0][-1:], np.zeros(1))[0]
        x[n : 2 * n] = solid @ line_features(counts, words, last, repeated) / total
        hashes = memo.of(words_of(text))
        x[2 * n] = repeat_words(hashes) / len(hashes)
        cells = np.bincount((hashes % np.uint64(WORD_CELLS)).astype(np.intp), minlength=WORD_CELLS)
        x[2 * n + 1 :] = np.sqrt(cells / len(hashes))
    return x


def metadata_view(lang, source, n_chars) -> np.ndarray:
    """Language and source in hashed cells, length in overlapping cells of powers of two; a missing value is a value too."""
    x = np.zeros(METADATA, np.float32)
    x[0] = 1
    x[1 + zlib.crc32(b"-" if lang is None else str(lang).encode()) % LANG_CELLS] = 1
    x[1 + LANG_CELLS + zlib.crc32(b"-" if source is None else str(source).encode()) % SOURCE_CELLS] = 1
    if n_chars is not None and n_chars == n_chars:
        place = np.log2(max(0, n_chars) + 1) - 4
        x[1 + LANG_CELLS + SOURCE_CELLS :] = np.maximum(0, 1 - np.abs(np.clip(place, 0, LENGTH_CELLS - 1) - np.arange(LENGTH_CELLS)))
    return x


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights of a ridge logistic model, by Newton's method."""
    w, weight = np.zeros(x.shape[1]), np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(curve, x.T @ (weight * (y - p)) - l2 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class CoTrained:
    """Weights of both views, (scale, shift) of each view's calibration, and of the combination."""

    content: np.ndarray
    metadata: np.ndarray
    scales: np.ndarray
    combined: np.ndarray
    rounds: int = 0
    exchanged: tuple[int, int] = (0, 0)

    def score(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """Columns: calibrated probability by content, by metadata, combined."""
        logits = np.column_stack([content @ self.content, metadata @ self.metadata]) * self.scales[:, 0] + self.scales[:, 1]
        both = self.combined[0] + logits @ self.combined[1:]
        return 1 / (1 + np.exp(-np.clip(np.column_stack([logits, both]), -30, 30)))


def sigmoid(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def pool_sums(views: tuple[np.ndarray, np.ndarray], weights: list[np.ndarray], sure: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(slope, curvature, rows) for each view and class: of the rows that the other view is sure to be of that class."""
    p = [sigmoid(x, w) for x, w in zip(views, weights)]
    out = []
    for own, other in ((0, 1), (1, 0)):
        for label, rows in ((0.0, p[other] <= 1 - sure), (1.0, p[other] >= sure)):
            x, q = views[own][rows], p[own][rows]
            out.append((x.T @ (label - q), (x * np.maximum(q * (1 - q), 1e-6)[:, None]).T @ x, float(rows.sum())))
    return out


def step(x: np.ndarray, y: np.ndarray, w: np.ndarray, sums: list[tuple[np.ndarray, np.ndarray, float]], share: float, l2: float = 1.0) -> np.ndarray:
    """A view's weights after one of Newton's steps on its labelled rows and what the other view handed on.

    The rows of a class that were handed on weigh `share` of all labelled rows together, however many they are.
    """
    p = sigmoid(x, w)
    slope, curve = x.T @ (y - p) - l2 * w, (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + l2 * np.eye(len(w))
    for own_slope, own_curve, rows in sums:
        if rows:
            slope, curve = slope + own_slope * (share * len(y) / rows), curve + own_curve * (share * len(y) / rows)
    return w + np.linalg.solve(curve, slope)


def co_train(content: np.ndarray, metadata: np.ndarray, y: np.ndarray, pool, rounds: int = 4, sure: float = 0.95, share: float = 0.25) -> CoTrained:
    """Fits both views; a fifth of the labelled rows (every fifth as given) is kept for calibration.

    pool(weights, sure) gives pool_sums over all unlabelled rows; each round asks it once, and either view learns from
    the rows that the other is sure of, then with fresh labels in the next round.
    """
    content, metadata = np.asarray(content, float), np.asarray(metadata, float)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    views, base, exchanged, done = (content[~held], metadata[~held]), y[~held], (0, 0), 0
    weights = [logistic(v, base) for v in views]
    for done in range(1, rounds + 1):
        sums = pool(weights, sure)
        exchanged = (int(sums[2][2] + sums[3][2]), int(sums[0][2] + sums[1][2]))
        weights = [step(v, base, w, own, share) for v, w, own in zip(views, weights, (sums[:2], sums[2:]))]
        if not any(exchanged):
            break
    fit = held if held.any() else np.ones(len(y), bool)
    logits = np.column_stack([content[fit] @ weights[0], metadata[fit] @ weights[1]])
    one = np.ones(len(logits))
    scales = np.array([logistic(np.column_stack([z, one]), y[fit], l2=0.1) for z in logits.T])
    calibrated = logits * scales[:, 0] + scales[:, 1]
    combined = logistic(np.column_stack([one, calibrated]), y[fit], l2=0.1)
    return CoTrained(weights[0], weights[1], scales, combined, done, exchanged)


DDL = "doc_id long, content_score double, metadata_score double, score double, kept boolean"


def _views(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, n_chars, each null where the table lacks the column."""
    column = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    return docs.select(column("doc_id", "long"), text_or_empty().alias("text"), column("lang", "string"), column("source", "string"), column("n_chars", "double"))


#: Words whose hashes a worker remembers, and documents whose texts it holds as Python strings at once.
REMEMBERED, TEXTS = 100_000, 256


def _contents(texts: pa.Array, memo: WordHashes) -> list[bytes]:
    """The content view of each text, packed."""
    return [content_view(t, memo).tobytes() for at in range(0, len(texts), TEXTS) for t in texts.slice(at, TEXTS).to_pylist()]


FEATURES_DDL = "doc_id long, content binary, lang string, source string, n_chars double"


def features(docs: DataFrame) -> DataFrame:
    """doc_id, the content view packed as 32-bit numbers, and what the metadata view reads; written once, as each round reads it."""

    def run(batches):
        memo = WordHashes(REMEMBERED)
        for batch in batches:
            packed = _contents(batch.column("text"), memo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary()), *(batch.column(c) for c in ("lang", "source", "n_chars"))], ["doc_id", "content", "lang", "source", "n_chars"])

    path = new_folder(docs.sparkSession, "features")
    _views(docs).mapInArrow(run, FEATURES_DDL).write.parquet(path)
    return docs.sparkSession.read.schema(FEATURES_DDL).parquet(path)


def _matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    content = np.frombuffer(b"".join(batch.column("content").to_pylist()), np.float32).reshape(-1, CONTENT)
    seen: dict[tuple, np.ndarray] = {}
    rows = zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
    metadata = np.array([seen.setdefault(v, metadata_view(*v)) if v not in seen else seen[v] for v in rows]).reshape(-1, METADATA)
    return content.astype(float), metadata.astype(float)


def _pool(rows: DataFrame):
    """pool_sums over all rows: each task adds up its own, tasks' sums are added in groups, and the driver gets one row per group."""
    schema = pa.schema([("part", pa.int64()), ("data", pa.binary())])

    def packed(part: int, sums) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": [part], "data": [np.concatenate([np.concatenate([s, c.ravel(), [n]]) for s, c, n in sums]).tobytes()]}, schema=schema)

    def pool(weights: list[np.ndarray], sure: float):
        def run(batches):
            total = None
            for batch in batches:
                own = pool_sums(_matrices(batch), weights, sure)
                total = own if total is None else [tuple(x + y for x, y in zip(a, b)) for a, b in zip(total, own)]
            if total is not None:
                yield packed(TaskContext.get().partitionId(), total)

        def add(batches):
            found = [np.frombuffer(d, "<f8") for _, d in sorted((p, d) for batch in batches for p, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))]
            if found:
                yield pa.RecordBatch.from_pydict({"part": [0], "data": [np.sum(found, axis=0).tobytes()]}, schema=schema)

        groups = rows.mapInArrow(run, "part long, data binary").repartition(16, F.pmod("part", F.lit(16))).mapInArrow(add, "part long, data binary")
        found = [np.frombuffer(r.data, "<f8") for r in groups.collect()]
        sizes = [CONTENT, CONTENT, METADATA, METADATA]
        total = np.sum(found, axis=0) if found else np.zeros(sum(n * n + n + 1 for n in sizes))
        out, at = [], 0
        for n in sizes:
            out.append((total[at : at + n], total[at + n : at + n + n * n].reshape(n, n), total[at + n + n * n]))
            at += n + n * n + 1
        return out

    return pool


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 4000, known: DataFrame | None = None) -> CoTrained | None:
    """Fits on a bounded sample of labelled documents, those of the lowest hashed identifiers, and on all unlabelled ones.

    `most_labelled` bounds the labelled feature rows that the driver gets. known: features of docs where there are any.
    None where the sample lacks good or bad documents.
    """
    spark = docs.sparkSession
    labelled = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("quality"))
    picked = labelled.orderBy(F.xxhash64("doc_id"), F.col("doc_id")).limit(most_labelled).collect()
    if len({r.quality for r in picked}) < 2:
        return None
    rows = features(docs) if known is None else known
    chosen = spark.createDataFrame(picked, "doc_id long, quality double")
    found = sorted(map(tuple, rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", *(c for c in rows.columns if c != "doc_id")).collect()), key=str)
    y = np.array([r[1] for r in found])
    if len(set(y)) < 2:
        return None
    batch = pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in found], kind) for i, (name, kind) in enumerate([("content", pa.binary()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.float64())], 2)})
    content, metadata = _matrices(batch)
    # joined and written once, as every round reads them
    path = new_folder(spark, "unlabelled")
    rows.join(labelled.select("doc_id"), "doc_id", "left_anti").write.parquet(path)
    return co_train(content, metadata, y, _pool(spark.read.schema(rows.schema).parquet(path)))


def score(docs: DataFrame, model: CoTrained | None, least: float = 0.5, known: DataFrame | None = None) -> DataFrame:
    """One row per document, in one pass without a shuffle: the calibrated views, their combination, kept or not.

    Without a model (no labels of both kinds) all scores are null and every document is kept. Missing texts count as
    empty; missing metadata is a value of its own; repeated rows and missing identifiers are scored like any other;
    other columns are ignored; an empty table gives no rows. known: features of docs where there are any.
    """

    made = known is not None

    def run(batches):
        memo = WordHashes(REMEMBERED)
        for batch in batches:
            if model is None:
                empty = pa.nulls(batch.num_rows, pa.float64())
                columns = [empty, empty, empty, pa.array([True] * batch.num_rows, pa.bool_())]
            else:
                if not made:
                    packed = pa.array(_contents(batch.column("text"), memo), pa.binary())
                    batch = pa.RecordBatch.from_arrays([batch.column("doc_id"), packed, *(batch.column(c) for c in ("lang", "source", "n_chars"))], ["doc_id", "content", "lang", "source", "n_chars"])
                p = model.score(*_matrices(batch))
                columns = [pa.array(c) for c in p.T] + [pa.array(p[:, 2] >= least)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "content_score", "metadata_score", "score", "kept"])

    return (known if made else _views(docs)).mapInArrow(run, DDL)


def fit_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score(docs) by a model fitted on docs, whose features are made once for both."""
    known = features(docs)
    return score(docs, fit(docs, labels, known=known), known=known)


def keep_good(docs: DataFrame, model: CoTrained | None, least: float = 0.5) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    if model is None:
        return docs

    @F.arrow_udf("boolean")
    def kept(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        packed = pa.array(_contents(text, WordHashes(REMEMBERED)), pa.binary())
        batch = pa.RecordBatch.from_arrays([packed, lang, source, n_chars], ["content", "lang", "source", "n_chars"])
        return pa.array(model.score(*_matrices(batch))[:, 2] >= least)

    column = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind)
    return docs.where(kept(text_or_empty(), column("lang", "string"), column("source", "string"), column("n_chars", "double")))
