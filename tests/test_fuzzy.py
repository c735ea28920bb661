"""The fuzzy join by inverted lists against all pairs."""

import random

import pytest

from isopleth.operators import relate
from isopleth.plans import registry
from tests.oracle import compare, connect


def frame(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize("seed", [1, 2])
def test_same_rows_as_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "data"] * 8 + ["a", "ab", "\u00e9t\u00e9"]
    some = lambda n: [" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(n)]
    catalog = some(120) + ["", "  Drought  Index ", "ERA5", "a", "b", None, "the the of", "x" * 80]
    names = some(80) + ["", " ", None, "drought index", "era5 land", "e", "a", "zz", "xx", "\u00c9T\u00c9 data", *catalog[:9], catalog[0], catalog[0].upper(), f"pre{catalog[1]}post"]
    for left, right in ((names, catalog), (names, [c for c in catalog if c]), (names, []), ([], catalog)):
        both = [sorted(map(tuple, run(frame(spark, left, "n"), frame(spark, right, "c")).collect())) for run in (relate.best_fuzzy, relate.best_fuzzy_indexed)]
        assert both[0] == both[1]


def test_candidates_are_few(spark):
    rng = random.Random(3)
    catalog = [f"{rng.randrange(10**6):06x} {rng.randrange(10**6):06x} station data" for _ in range(1500)]
    names = [c.replace("station", "site") for c in catalog[:300]]
    pairs = relate.fuzzy_candidates(frame(spark, names, "n"), frame(spark, catalog, "c")).collect()
    assert len(pairs) < 300 * 20 and {(r.name, r.match) for r in pairs} >= set(zip(names, catalog))


def test_twin(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf), sf, registry.queries()["fuzzy_match_indexed"], registry.oracle_sql()["fuzzy_match_indexed"]) > 0
