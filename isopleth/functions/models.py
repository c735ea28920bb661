"""Model calls with deterministic defaults that need no network: embedding, reranking, text generation.

A real model replaces a default by passing another function with the same signature.
"""

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 256
#: embed: texts to unit vectors. rerank: (questions, passages) to scores. generate: prompt to text, or None for no answer.
Embed = Callable[[list[str]], np.ndarray]
Rerank = Callable[[list[str], list[str]], list[float]]
Generate = Callable[[str], str | None]


def words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


class Places(dict):
    """Each word's place in a count of 2 * DIMENSIONS, those that count up in the upper half; up to `most` words are remembered."""

    most = 1 << 18

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode())
        place = h % DIMENSIONS + (h >> 31) * DIMENSIONS
        if len(self) < self.most:
            self[word] = place
        return place


_PLACES = Places()


def hashed_embedding(texts: list[str]) -> np.ndarray:
    """Signed hashed word counts with dampened repeats, of unit length; zeros for a text without words."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in enumerate(texts):
        counts = np.bincount(np.array([*map(_PLACES.__getitem__, words(text))], np.intp), minlength=2 * DIMENSIONS)
        out[row] = counts[DIMENSIONS:] - counts[:DIMENSIONS]
    out = np.sign(out) * np.sqrt(np.abs(out))
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def lexical_overlap(questions: list[str], passages: list[str]) -> list[float]:
    """The share of a question's different words that a passage has."""
    found = []
    for question, passage in zip(questions, passages):
        own = set(words(question))
        found.append(len(own & set(words(passage))) / len(own) if own else 0.0)
    return found


def embedded(text: Column, embed: Embed = hashed_embedding, batch: int = 64) -> Column:
    """Unit vectors of texts (missing: empty), in batches; a model is loaded once per worker by its function."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            values = texts.tolist()
            parts = [embed(values[i : i + batch]) for i in range(0, len(values), batch)]
            yield pd.Series([row for part in parts for row in part], index=texts.index, dtype=object)

    return run(F.coalesce(text, F.lit("")))


def reranked(question: Column, passage: Column, rerank: Rerank = lexical_overlap) -> Column:
    """A second score of each hit by a model that reads question and passage together."""

    @F.pandas_udf("double")
    def run(questions: pd.Series, passages: pd.Series) -> pd.Series:
        return pd.Series(rerank(questions.tolist(), passages.tolist()), index=questions.index, dtype=float)

    return run(F.coalesce(question, F.lit("")), F.coalesce(passage, F.lit("")))
