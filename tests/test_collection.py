"""The collection's buckets, versions, conflicts and streams."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from isopleth.operators.collection import Collection
from isopleth.streaming import events

SCHEMA = "id string, source string, n int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def files(folder):
    return set(glob.glob(f"{folder}/data/*/*/*.parquet"))


def content(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


def test_an_upsert_writes_touched_buckets_alone(spark, tmp_path):
    table, rows = Collection(spark, str(tmp_path / "c"), buckets=32, spread=4), [(f"k{i}", f"s{i % 5}", i) for i in range(400)]
    first = table.upsert(frame(spark, rows))
    before, paths = files(tmp_path / "c"), table.manifest()["paths"]
    assert len(paths) == 32 and content(table) == sorted(rows)
    second = table.upsert(frame(spark, [("k7", "s2", -7), ("new", None, 1), ("k7", "s2", -8)]), order=["n"])
    after, changed = table.manifest()["paths"], table.manifest()["changed"]
    assert 1 <= len(changed) <= 2 and {b for b in paths if paths[b] != after[b]} == set(changed)
    assert len(files(tmp_path / "c") - before) <= 2 * len(changed)  # what stays of a bucket, and what is new
    changed_rows = sorted(r for r in rows if r[0] != "k7") + [("k7", "s2", -7), ("new", None, 1)]
    assert sorted(content(table), key=repr) == sorted(changed_rows, key=repr)
    assert content(table, first) == sorted(rows)
    assert [tuple(r) for r in table.lookup(spark.createDataFrame([("k7",), ("none",)], "id string")).collect()] == [("k7", "s2", -7)]
    table.restore(first)
    assert content(table) == sorted(rows)
    assert table.vacuum(keep=3, grace=0) == 0 and content(table, second)
    assert table.vacuum(grace=0) == len(changed) + len(set(after) - set(paths)) or table.versions()
    assert len(table.versions()) == 1 and content(table) == sorted(rows) and files(tmp_path / "c") == before


def test_a_group_lives_in_its_own_buckets(spark, tmp_path):
    table = Collection(spark, str(tmp_path / "c"), group="source", buckets=64, spread=4)
    rows = [(f"k{i}", "hot" if i % 3 else f"s{i % 7}", i) for i in range(600)]
    table.commit(frame(spark, rows))
    again = [(f"k{i}", "hot", -i) for i in range(1, 50, 3)]
    table.replace("source", "hot", frame(spark, again))
    assert len(table.manifest()["changed"]) == 4
    assert content(table) == sorted([r for r in rows if r[1] != "hot"] + again)
    same = table.versions()[-1]
    assert table.replace("source", "hot", frame(spark, []), unless_empty=True) == same
    table.replace("source", "hot", frame(spark, []))
    assert content(table) == sorted(r for r in rows if r[1] != "hot")
    reopened = Collection(spark, str(tmp_path / "c"))
    assert reopened.layout == table.layout
    reopened.delete(F.col("n") == 3)
    assert len(reopened.manifest()["changed"]) == 1
    reopened.update(F.col("source") == "s1", {"n": F.lit(0)})
    assert sorted(content(reopened)) == sorted((k, s, 0 if s == "s1" else n) for k, s, n in rows if s != "hot" and n != 3)
    with pytest.raises(ValueError):
        reopened.update(F.lit(True), {"source": F.lit("x")})
    with pytest.raises(ValueError):
        reopened.upsert(frame(spark, again), ["n"])


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    mine, other = (Collection(spark, str(tmp_path / "c"), buckets=16, spread=1) for _ in range(2))
    mine.commit(frame(spark, [(f"k{i}", "s", 0) for i in range(64)]))
    publish, made = Collection._publish, []

    def late(self, number, manifest):
        if self is mine and not made:
            made.append(number)
            other.upsert(frame(spark, [(clash, "s", 2)]))
        return publish(self, number, manifest)

    monkeypatch.setattr(Collection, "_publish", late)
    writes = []
    write = Collection._write
    monkeypatch.setattr(Collection, "_write", lambda self, rows: writes.append(self is mine) or write(self, rows))
    bucket = lambda k: frame(spark, [(k, "s", 0)]).select(mine.bucket()).first()[0]
    apart = next(f"k{i}" for i in range(1, 64) if bucket(f"k{i}") != bucket("k0"))
    near = next((f"k{i}" for i in range(1, 64) if bucket(f"k{i}") == bucket("k0")), "k0")
    for clash, rewritten in ((apart, 2), (near, 3)):
        made.clear()
        writes.clear()
        mine.upsert(frame(spark, [("k0", "s", 1)]))
        assert sum(writes) == rewritten  # what stays is written again only where both changed a bucket
        found = {r.id: r.n for r in mine.read().collect()}
        assert found["k0"] == 1 and found[clash] == 2 and len(found) == 64
        other.upsert(frame(spark, [(clash, "s", 0), ("k0", "s", 0)]))


@pytest.mark.parametrize("add", ["append", "upsert"])
def test_a_stream_is_written_once(spark, tmp_path, monkeypatch, add):
    table = Collection(spark, str(tmp_path / "c"), buckets=4, spread=1)
    (tmp_path / "in").mkdir()
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).csv(str(tmp_path / "in"))
    run = lambda: events.ingest_stream(read(), table, "in", str(tmp_path / "done"), add=add)
    (tmp_path / "in" / "a.csv").write_text("a,s,1\nb,s,2\n")
    run()
    publish = Collection._publish
    for moment in ("before", "after"):
        (tmp_path / "in" / f"{moment}.csv").write_text(f"{moment},s,3\n")

        def killed(self, number, manifest, moment=moment):
            if moment == "after":
                publish(self, number, manifest)
            raise RuntimeError("killed")

        monkeypatch.setattr(Collection, "_publish", killed)
        with pytest.raises(Exception, match="killed"):
            run()
        monkeypatch.setattr(Collection, "_publish", publish)
        run()
    assert content(table) == [("a", "s", 1), ("after", "s", 3), ("b", "s", 2), ("before", "s", 3)]
    named = {os.path.join(str(tmp_path / "c"), "data", p) for found in table.manifest()["paths"].values() for p in found}
    assert {os.path.dirname(f) for f in files(tmp_path / "c")} > named  # the batch that was killed has left files
    table.vacuum(grace=0)
    assert {os.path.dirname(f) for f in files(tmp_path / "c")} == named and len(content(table)) == 4
