"""The prefix trie against plain sets of prefixes, and against SQL."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from isopleth.llm import queries
from isopleth.llm.prefixtrie import prefix_trie
from tests.oracle import compare, connect

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in turns.items()}
    members, ends, children, leaves, saved = defaultdict(list), defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for conv, mine in own.items():
        h, base = zlib.crc32(str(conv).encode()) % 4, conv - (abs(conv) % 20) * (1 if conv >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + mine[h:])
        ends[path].append(conv)
        for depth in range(len(path) + 1):
            members[path[:depth]].append(conv)
            if depth:
                children[path[: depth - 1]].add(path[:depth])
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0)
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()), key=repr)


def same(conv, *texts):
    return [(conv, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]


ROWS = [
    *same(0, "a b", "c", "d e f"), *same(1, "a b", "c"), *same(2, "a b", "c"), *same(3, "a b"), *same(20, "x", None, ""), *same(21, "x"), *same(45, "y", "z w \x0b v", "long " * 3000), *same(-5, "a b"), *same(-25, "a b", "q"),
    (7, None, None, None), (7, 1, "user", "t"), (7, 1, "user", "t"), (7, 1, "assistant", "t"), (None, 0, "user", "lost"), (41, 2**40, "us", "er"), (42, 1, "user", ""), *[r for c in range(100, 140) for r in same(c, "a b", "c", "e")],
    *same(200, *map(str, range(120))), *same(201, *map(str, range(120))), *same(202, *map(str, range(90))),
]


@pytest.mark.parametrize("shard,turns", [(2048, 10**6), (7, 10**6), (1, 10**6), (100, 60)])
def test_edges(spark, shard, turns):
    rows = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS depth", "'x' AS path", "2 AS words", "3 AS key").repartition(3)
    found = prefix_trie(rows, shard=shard, shard_turns=turns).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=repr) == plain(ROWS)


def test_hot_turns_over_partitions(spark):
    rows = [r for c in range(600) for r in same(c, "hello", "hi", *(["same"] if c % 3 else [f"own {c % 50}"]))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), shard=16).select(*COLUMNS).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, found), key=repr) == plain(rows)


def test_empty(spark):
    assert prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_twin(spark, sf):
    sf = f"/root/testdata/{sf}"
    assert compare(spark, connect(sf), sf, queries.op13_prefix_trie, queries.OP13_SQL) > 0
