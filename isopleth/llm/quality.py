"""Quality rules with a linear-chain conditional random field over lines.

Each line with a word is marked content or boilerplate by Viterbi decoding; the share of content among the characters
of words decides whether the text is kept, after plain rules on length and repetition.
"""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isopleth.llm.common import ODD_SPACE, WORD, Rows, cut, text_or_empty
from isopleth.llm.fingerprints import WordHashes, shingles
from isopleth.llm.linestats import BLANK, BREAK, FEATURES, PIPE, SYMBOL, line_features, line_stats, repeated_lines

_WORD = re.compile(WORD)
BOILERPLATE, CONTENT = 0, 1


class ChainField:
    """A linear-chain CRF of two states: a weight per state and feature, and one per pair of states."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros((2, len(FEATURES))) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves

    @classmethod
    def prior(cls) -> "ChainField":
        """Weights for when no labelled rows are given: symbols, bars, shouting and capitals speak against content."""
        field = cls(moves=np.array([[0.5, 0.0], [0.0, 0.5]]))
        field.weights[CONTENT, [FEATURES.index(f) for f in ("bias", "symbols", "pipes", "shouts", "capitals", "repeated")]] = [2.0, -4.0, -4.0, -4.0, -4.0, -1.0]
        return field

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most likely states (Viterbi); content where both are as likely."""
        scores = (x @ self.weights.T).tolist()
        (bb, bc), (cb, cc) = self.moves.tolist()
        b, c = scores[0]
        back = []
        for sb, sc in scores[1:]:
            from_b, from_c = c + cb < b + bb, c + cc < b + bc
            back.append((from_b, from_c))
            b, c = sb + (b + bb if from_b else c + cb), sc + (b + bc if from_c else c + cc)
        state, states = c >= b, [c >= b]
        for from_b, from_c in reversed(back):
            state = not (from_c if state else from_b)
            states.append(state)
        return np.array(states[::-1], np.intp)

    def fit(self, chains: list[np.ndarray], labels: list[np.ndarray], steps: int = 150, l2: float = 1e-3, rate: float = 0.2) -> "ChainField":
        """Maximises the likelihood of the labelled chains (forward-backward gradients, Adam), all chains at once."""
        longest, n = max(map(len, chains)), len(chains)
        x, y, there = np.zeros((n, longest, len(FEATURES))), np.zeros((n, longest), np.intp), np.zeros((n, longest), bool)
        for i, (a, b) in enumerate(zip(chains, labels)):
            x[i, : len(a)], y[i, : len(b)], there[i, : len(a)] = a, b, True
        pair = there[:, 1:]
        seen_w = np.stack([(x * ((y == s) & there)[..., None]).sum((0, 1)) for s in (0, 1)])
        seen_m = np.array([[((y[:, :-1] == s) & (y[:, 1:] == t) & pair).sum() for t in (0, 1)] for s in (0, 1)], float)
        theta, m, v, total = np.concatenate([self.weights.ravel(), self.moves.ravel()]), 0.0, 0.0, there.sum()
        for step in range(1, steps + 1):
            weights, moves = theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2)
            scores = x @ weights.T
            forward, backward = scores.copy(), np.zeros_like(scores)
            for t in range(1, longest):
                arriving = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + scores[:, t]
                forward[:, t] = np.where(there[:, t, None], arriving, forward[:, t - 1])
            for t in range(longest - 2, -1, -1):
                leaving = np.logaddexp.reduce(moves + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
                backward[:, t] = np.where(there[:, t + 1, None], leaving, 0)
            norm = np.logaddexp.reduce(forward[:, -1], axis=1)
            share = np.exp(forward + backward - norm[:, None, None]) * there[..., None]
            pairs = np.exp(forward[:, :-1, :, None] + moves + (scores + backward)[:, 1:, None, :] - norm[:, None, None, None]) * pair[..., None, None]
            slope = np.concatenate([(seen_w - np.einsum("nts,ntf->sf", share, x)).ravel(), (seen_m - pairs.sum((0, 1))).ravel()]) / total - l2 * theta
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        return ChainField(theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2))


def chain(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features of the lines with a word, characters of their words, kinds per line, which lines repeat)."""
    counts, words, last = line_stats(text)
    repeated = repeated_lines(text.split("\n"))
    there = words > 0
    solid = counts.sum(1) - counts[:, BLANK] - counts[:, BREAK]
    x = line_features(counts[there], words[there], last[there], repeated[there]) if there.any() else np.zeros((0, len(FEATURES)))
    return x, solid[there], counts, repeated


def repeat_words(hashes: np.ndarray, n: int = 5) -> int:
    """Words inside windows of n words that the text has twice or more, first ones included."""
    if len(hashes) <= n:
        return 0
    _, place, times = np.unique(shingles(hashes, n), return_inverse=True, return_counts=True)
    twice = times[place] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def fit_field(docs: DataFrame, labels: DataFrame, most_docs: int = 3000, most_lines: int = 64, most_lines_in_all: int = 200_000) -> ChainField:
    """Fits the field on a bounded sample: the `most_docs` labelled documents of the lowest hashed identifiers, whole ones
    as long as they have `most_lines_in_all` lines together.

    Lines of good documents are content; lines of bad ones are boilerplate at first, and after a first fit those that
    look more like content keep that state for a second fit. Chains are cut into runs of `most_lines`. Without labels
    of both kinds the prior weights are taken.
    """
    chosen = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    spark, picked = docs.sparkSession, chosen.collect()
    if len({r.quality for r in picked}) < 2:
        return ChainField.prior()
    picked = spark.createDataFrame(picked, chosen.schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id")

    def features(batches):
        for batch in batches:
            for key, text, quality in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "quality"))):
                x = chain(text)[0]
                for run, at in enumerate(range(0, len(x), most_lines)):
                    yield pa.RecordBatch.from_pydict({"doc_id": [key], "quality": [int(quality)], "run": [run], "lines": [len(x)], "x": [x[at : at + most_lines].ravel().tolist()]})

    runs = cut(rows.mapInArrow(features, "doc_id long, quality long, run long, lines long, x array<double>"))
    room, whole = most_lines_in_all, []
    for r in runs.where("run = 0").select("doc_id", "lines").groupBy("doc_id").agg(F.sum("lines").alias("lines")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r.lines > room:
            break
        room -= r.lines
        whole.append((r.doc_id,))
    runs = runs.join(F.broadcast(spark.createDataFrame(whole, "doc_id long")), "doc_id")
    found = sorted(runs.collect(), key=lambda r: (r.doc_id, r.run, r.x))
    if len({r.quality for r in found}) < 2:
        return ChainField.prior()
    chains = [np.array(r.x).reshape(-1, len(FEATURES)) for r in found]
    states = [np.full(len(c), r.quality, np.intp) for c, r in zip(chains, found)]
    field = ChainField().fit(chains, states, steps=80)
    alone = ChainField(field.weights)
    states = [np.full(len(c), CONTENT, np.intp) if r.quality else alone.decode(c) for c, r in zip(chains, found)]
    return field.fit(chains, states, steps=80)


RULES = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64()), ("content_lines", pa.int64()), ("lines", pa.int64())]
)
RULES_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, content_lines long, lines long"


def judge(text: str, field: ChainField, memo: WordHashes, least_words: int = 10, most_repeat: int = 20, least_content: float = 0.5) -> tuple:
    """The columns of RULES for one whole text, but for the identifier."""
    words = _WORD.findall(text) if ODD_SPACE.search(text) else text.split()
    x, solid, counts, repeated = chain(text)
    again = repeat_words(memo.of(words))
    failed = len(words) < least_words or 100 * again > most_repeat * len(words)
    states = field.decode(x) if len(x) else np.zeros(0, np.intp)
    total = int(solid.sum())
    share = float(solid[states == CONTENT].sum() / total) if total else 0.0
    symbols = int(counts[:, SYMBOL].sum() + counts[:, PIPE].sum())
    return len(words), total, symbols, int(repeated.sum()), again, failed, not failed and share >= least_content, share, int((states == CONTENT).sum()), len(x)


def apply_rules(docs: DataFrame, field: ChainField) -> DataFrame:
    """One row per document, in one pass without a shuffle.

    A missing or empty text has no words and fails; repeated rows and missing identifiers are judged like any other;
    an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        memo, rows = WordHashes(), Rows(RULES)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.add(key, *judge(text, field, memo))
                if rows.full():
                    yield rows.take()
        yield rows.take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, RULES_DDL)


def keep_good(docs: DataFrame, field: ChainField) -> DataFrame:
    """The documents that the rules keep, with all their columns."""

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        memo = WordHashes()
        return texts.map(lambda t: judge(t, field, memo)[6]).astype(bool)

    return docs.where(kept(text_or_empty()))
