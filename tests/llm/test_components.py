"""Components against a plain union-find."""

import random

from isopleth.llm.components import components


def plain(links):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {x: root(x) for x in up}


def test_components(spark):
    rng = random.Random(5)
    for links in (
        [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1, 1), (None, 3), (7, 900), (900, 7), (7, 900)],
        [(i, i + 1) for i in range(60)],
        [(5000, i) for i in range(300)],
        [],
    ):
        found = components(spark.createDataFrame(links, "a long, b long")).collect()
        assert len(found) == len({r.node for r in found})
        assert {r.node: r.component for r in found} == plain(links)
