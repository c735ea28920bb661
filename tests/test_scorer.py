"""The scorer of packed queries and points: equal to a full sort, in bounded memory."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from isopleth.operators import retrieve


def _pair(queries: int, points: int, size: int = 16):
    rng = np.random.default_rng(1)
    packed = lambda n, name: retrieve._ipc(pa.RecordBatch.from_pandas(pd.DataFrame({name: np.arange(n), "embedding": list(rng.normal(size=(n, size)).astype(np.float32)), "label": np.arange(n) % 5}), preserve_index=False))
    return pa.RecordBatch.from_pydict({"queries": [packed(queries, "query_id")], "data": [packed(points, "id")]})


@pytest.mark.parametrize("k", [1, 3, 7, 50])
def test_foremost_equals_a_stable_sort(k):
    scores = np.random.default_rng(2).integers(0, 4, (40, 30)) / 4.0
    scores[3], scores[4, :28], scores[5, 2] = -np.inf, np.nan, np.nan
    want = [(r, c) for r in range(40) for c in sorted(np.flatnonzero(np.isfinite(scores[r])), key=lambda c: (-scores[r, c], c))[:k]]
    assert list(zip(*map(np.ndarray.tolist, retrieve._foremost(scores.copy(), k)))) == want
    assert len(retrieve._foremost(np.zeros((2, 0)), k)[0]) == 0


@pytest.mark.parametrize("same", [None, ("label", "label")])
def test_memory_of_a_large_block_is_bounded(same):
    batch = _pair(2000, 8192)
    tracemalloc.start()
    found = pd.concat(b.to_pandas() for b in retrieve._scorer("query_id", "embedding", "id", ["label"], 10, same)([batch]))
    assert tracemalloc.get_traced_memory()[1] < 80_000_000  # the block's scores alone are 131 MB
    tracemalloc.stop()
    assert len(found) == 20_000 and found.groupby("query_id").size().eq(10).all()
    assert not same or (found["label"] == found["query_id"] % 5).all()
