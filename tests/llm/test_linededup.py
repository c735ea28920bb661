"""Line dedup against brute force over all pairs of lines."""

import random

import pytest
from pyspark.sql import functions as F

from isopleth.llm import linededup as ld
from tests.llm.test_components import plain


def sets(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def near(a, b):
    common = len(a & b)
    return 10 * common >= 8 * (len(a) + len(b) - common)


def norm(line):
    return line.strip(" \t\r\x0b\x0c").lower()


def brute(docs):
    first = {}
    for key, text in sorted((k, t) for k, t in docs if k is not None and t is not None):
        for pos, line in enumerate(text.split("\n")):
            if norm(line):
                first.setdefault(norm(line), (key, pos))
    lines = sorted(first.items(), key=lambda x: x[1])
    found = [(sets(x), code) for x, code in sorted(lines, key=lambda x: len(sets(x[0])))]
    links = []
    for i, (x, a) in enumerate(found):
        for y, b in found[i + 1 :]:
            if 8 * len(y) > 10 * len(x):
                break
            if near(x, y):
                links.append((a, b))
    up = plain(links)
    keep = {up.get(code, code) for _, code in lines}
    out = {}
    for key, text in docs:
        if key is not None and text is not None:
            out[key] = "\n".join(line for pos, line in enumerate(text.split("\n")) if not norm(line) or (key, pos) in keep)
    return out


def test_small(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    bases = ["".join(rng.choice(letters + "    ") for _ in range(rng.choice([6, 12, 30, 90, 300, 900]))) + "q" for _ in range(40)]
    rows = []
    for key in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 0, 1, len(line) // 100])):
                line[rng.randrange(len(line))] = rng.choice("éXyz中")
            lines.append(rng.choice(["", " "]) + "".join(line))
            if rng.random() < 0.2:
                lines.append(rng.choice(["", " \t", "ab", "Ab", "中文"]))
        rows.append((key * 11 - 100, "\n".join(lines)))
    rows += [(700, None), (701, ""), (None, "ab"), (702, "x" * 30000 + "\n" + "x" * 29999), (703, "\U0001f600" * 9)]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, code int, keep int")
    found = {r.doc_id: r for r in ld.dedup_lines(docs).collect()}
    expected = brute(rows)
    assert len(found) == len(rows) and found[700].text is None and found[None].text == "ab"
    got = {k: r.text for k, r in found.items() if k in expected}
    wrong = [k for k in expected if got[k] != expected[k]]
    assert len(wrong) <= 1, [(k, got[k], expected[k]) for k in wrong]
    assert all(r.n_kept <= r.n_lines for r in found.values())
    assert ld.dedup_lines(docs.limit(0)).count() == 0


def test_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    expected = brute(rows)
    got = {r.doc_id: r.text for r in ld.dedup_lines(docs).collect()}
    lines = lambda found: {(k, line) for k, t in found.items() for line in t.split("\n")}
    assert lines(got) >= lines(expected)  # nothing is dropped that brute force keeps
    extra = len(lines(got) - lines(expected))
    dropped = sum(len(t.split("\n")) for _, t in rows) - sum(len(t.split("\n")) for t in expected.values())
    assert extra <= 0.02 * dropped


def variants(seed, families, length, far, near_by):
    """A template, and pairs of lines that are near each other (near_by edits) but not the template (far edits)."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz    "

    def edited(line, n):
        line = list(line)
        for at in rng.sample(range(len(line)), n):
            line[at] = rng.choice("0123456789")
        return "".join(line)

    base = "".join(rng.choice(letters) for _ in range(length)) + "q"
    lines = [base] * 5
    for _ in range(families):
        one = edited(base, far)
        lines += [one, edited(one, near_by)]
    rng.shuffle(lines)
    return [(i, line) for i, line in enumerate(lines)]


def test_every_pair_of_a_bucket_is_compared(spark):
    signed = spark.createDataFrame([(i, *[5] * ld.MINIMA) for i in range(30)], ["p", *(f"m{j}" for j in range(ld.MINIMA))])
    every = {(p, q) for p in range(30) for q in range(p)}
    rows = ld.keyed(signed)
    buckets = ld.buckets_of(rows)
    assert {tuple(r) for r in ld.small_pairs(rows, buckets).collect()} == every
    assert not ld.large_members(rows, buckets).count() and not ld.small_pairs(rows, buckets, small=20).count()
    members = ld.large_members(rows, buckets, small=20)
    first = ld.cut(ld.hub_pairs(members))
    labels = spark.createDataFrame([(3, 100), (4, 100), (5, 100)], "p long, component long")
    others = {tuple(r) for r in ld.other_pairs(members, labels, first, block=4).collect()}
    done = {tuple(r) for r in first.collect()}
    joined = {(4, 3), (5, 3), (5, 4)}
    assert not others & done and not others & joined
    assert others | done | joined == every


def probe(spark, seed, shared, own):
    """Pairs of lines of one template: (lines kept, lines that brute force keeps, lines)."""
    rng, lines = random.Random(seed), []
    letters = "abcdefghijklmnopqrstuvwxyz    "
    base = "".join(rng.choice(letters) for _ in range(shared))
    for _ in range(400):
        mine = "".join(rng.choice(letters) for _ in range(own - 1)) + "x"
        lines += [base + mine, base + mine[:-1] + "y"]
    rng.shuffle(lines)
    rows = list(enumerate(lines))
    got = {r.doc_id for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_kept}
    return got, {k for k, t in brute(rows).items() if t}, rows


@pytest.mark.parametrize("shared,own", [(150, 26), (160, 19)])
def test_templated_lines(spark, shared, own):
    got, expected, rows = probe(spark, shared, shared, own)
    assert expected <= got and len(rows) - len(got) >= 0.95 * (len(rows) - len(expected))


def test_repeated_identifiers_and_clashing_names(spark):
    rows = [(1, "this line goes on and goes on for long"), (2, "an unlike and unique line"), (2, "this line goes on and goes on for lonk"), (3, "same\n\nrow"), (3, "same\n\nrow"), (3, None), (3, None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, `_keep` int, line_gone int, `a.b` int")
    found = ld.dedup_lines(docs)
    assert set(found.columns) == {*docs.columns, "n_lines", "n_kept"}
    assert sorted(((r.doc_id, r.text, r.n_kept) for r in found.collect()), key=str) == sorted([(1, rows[0][1], 1), (2, rows[1][1], 1), (2, "", 0), (3, "same\n\nrow", 2), (3, "", 0), (3, None, 0), (3, None, 0)], key=str)


def test_near_lines_that_no_hub_is_near_to(spark):
    rows = variants(1, 150, 200, 7, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in ld.dedup_lines(docs).collect() if r.n_kept}
    expected = {k for k, t in brute(rows).items() if t}
    assert expected <= got and len(got - expected) <= 0.02 * (len(rows) - len(expected))


def test_pairs_at_the_threshold_share_a_bucket(spark):
    rng, rows = random.Random(2), []
    letters = "abcdefghijklmnopqrstuvwxyz   "
    while len(rows) < 3000:
        one = "a" + "".join(rng.choice(letters) for _ in range(rng.choice([38, 78, 198, 398]))) + "b"
        two = list(one)
        for _ in range(max(1, int(len(one) * rng.uniform(0.012, 0.024)))):
            two[rng.randrange(1, len(one) - 1)] = rng.choice("0123456789")
        a, b = sets(one), sets("".join(two))
        if near(a, b) and len(a & b) < 0.82 * len(a | b):
            rows += [(len(rows), one), (len(rows) + 1, "".join(two))]
    signed = ld.signatures(ld.lines_of(spark.createDataFrame(rows, "doc_id long, text string")))
    keys = ld.keyed(signed.withColumn("p", F.col("doc_id")))
    pairs = keys.groupBy("key", F.floor(F.col("p") / 2).alias("pair")).agg(F.count("*").alias("n")).where("n > 1")
    assert pairs.select("pair").distinct().count() >= 0.99 * len(rows) / 2


def test_lines_of_few_distinct_shingles(spark):
    pairs = [("-" * 10, "-" * 12), ("buy now! " * 60, "buy now! " * 61), ("contacts", "contacts."), ("x" * 30000, "x" * 29999), ("ab cd " * 3000, "ab cd " * 2000 + "ab")]
    rows = [(2 * i + k, text) for i, pair in enumerate(pairs) for k, text in enumerate(pair)] + [(702, "y" * 30000 + "\n" + "y" * 29999)]
    found = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute(rows) and found[702] == "y" * 30000


def test_unlike_lines_of_one_language_hardly_meet(spark):
    rng = random.Random(6)
    syllables = ["th", "in", "er", "an", "on", "re", "ti", "ou"]
    rows = [(i, "".join(rng.choice(syllables) + rng.choice(["", "", " "]) for _ in range(400))) for i in range(600)]
    rows += [(600 + i, rows[i][1][:-9] + "another x") for i in range(20)]
    signed = ld.signatures(ld.lines_of(spark.createDataFrame(rows, "doc_id long, text string"))).withColumn("p", F.col("doc_id"))
    keys = ld.cut(ld.keyed(signed))
    buckets = ld.buckets_of(keys)
    pairs = {tuple(r) for r in ld.small_pairs(keys, buckets, small=600).distinct().collect()}
    assert {(600 + i, i) for i in range(20)} <= pairs and len(pairs) < 2000


def test_unlike_lines_of_one_template_are_not_all_compared(spark, monkeypatch):
    rng, compared, exact = random.Random(11), [], ld.verified
    letters = "abcdefghijklmnopqrstuvwxyz    "
    some = lambda n: "".join(rng.choice(letters) for _ in range(n - 1)) + "x"
    base, many = some(255), 150
    rows = [(i, some(45) + base) for i in range(many)]
    rows += [(many, rows[0][1][:-1] + "y"), (many + 1, rows[70][1][:-1] + "z")]
    monkeypatch.setattr(ld, "verified", lambda *x: (compared.append(x[-1].count()), exact(*x))[1])
    found = {r.doc_id for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_kept}
    assert found == set(range(many))
    assert 2 <= sum(compared) < 0.15 * many * (many - 1) / 2  # all pairs of the template before


def test_sketches_let_every_similar_pair_pass(spark):
    rng = random.Random(12)
    lines, pairs = [], []
    for length in (3, 8, 40, 90, 300, 1500, 6000):
        for share in (0, 0.002, 0.01, 0.02, 0.03, 0.05, 0.1):
            one = "".join(rng.choice("abcde fgh\U0001f600é") for _ in range(length))
            two = "".join(rng.choice("xyz") if rng.random() < share else c for c in one)
            pairs.append((len(lines) + 1, len(lines)))
            lines += [one, two]
    sketched = ld.sketches(spark.createDataFrame(list(enumerate(lines)), "p long, norm string"))
    assert {r.p: r.n for r in sketched.collect()} == {p: len(sets(x)) for p, x in enumerate(lines)}
    passed = {tuple(r) for r in ld.likely_pairs(spark.createDataFrame(pairs, "p long, q long"), sketched).collect()}
    similar = {(p, q) for p, q in pairs if near(sets(lines[p]), sets(lines[q]))}
    assert similar <= passed and 5 < len(similar) and len(passed) < len(pairs)
