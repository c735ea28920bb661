"""Scores, payloads, schedules, archives and the scanners' edge cases against plain Python."""

import gzip
import io
import struct
import tarfile
import unicodedata
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopleth.functions import catalog, descriptions, scalars, texts
from isopleth.operators import bookkeeping, collection, payload, scores, summarize
from isopleth.plans import answer, ingest
from isopleth.sources import archives, delimited, grid


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_scores(spark):
    lit = lambda values: F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
    found = lit(["the era5 heat map {}", "only noise here", "grace mass 272.82"])
    row = one(
        spark, relevance=scores.context_relevance(found, lit(["ERA5", "flood"]), lit(["noise"])), faith=scores.faithfulness(F.lit("about 272.9 degrees, 99.9 in 1999"), found),
        hedge=scores.faithfulness(F.lit("no data, 55.5"), found), none=scores.faithfulness(F.lit(""), found), precision=scores.precision_at(found, lit(["grace"]), 2),
        correct=scores.correctness(F.lit("CO₂ rises"), lit(["co2", "ice"]), F.lit("which carbon dioxide rises"), F.lit("CO2 rises")), empty=scores.diversity(lit([])),
        hits=scores.dataset_hits(found, lit(["C3S", "CAMS", "GRACE-FO"])), cover=scores.number_coverage(F.lit("12.5 and 7"), lit(["12.5", "8"])), no_answer=scores.first_score(F.lit(1.0), F.lit(0.5), F.lit(None).cast("double")),
    )
    assert row.relevance == round(0.6 * 0.5 + 0.4 * 2 / 3, 3)
    assert row.faith == round(0.6 * 1 / 2 + 0.4, 3)  # 272.9 is near 272.82, 1999 is a year
    assert row.hedge == 0.7 and row.none == 0.0 and row.precision == 0.0 and row.empty == 0.0
    assert row.correct == round(0.7 * 0.5 + 0.3 * 1 / 3, 3) and row.hits == ["C3S", "GRACE-FO"] and row.cover == 0.5 and row.no_answer == pytest.approx(0.775)
    assert spark.createDataFrame([("x²",), (None,)], "t string").select(scores.nfkd("t")).first()[0] == unicodedata.normalize("NFKD", "x²")


def test_payload(spark):
    rows = spark.createDataFrame([(0.0, 3.5, "[2, 3]", [float(i) for i in range(8)], ("a", None), None, float("nan"))], "lat_min double, min_lat double, shape string, stats array<double>, attrs struct<x:string,y:string>, other string, resolution double")
    falsy, plain = payload.normalize(rows).first(), payload.normalize(rows, falsy=False).first()
    assert falsy.latitude_min == 3.5 and plain.latitude_min == 0.0 and falsy.grid_shape == [2, 3] and falsy.stats_p10 == 4.0
    assert falsy.extras == {"attrs_x": "a"} and falsy.variable == "unknown"
    found = payload.normalize(rows)
    values = found.select(payload.to_payload(found)).first()[0]
    assert values["attrs_x"] == "a" and "resolution_deg" not in values and "long_name" not in values and values["stats_mean"] == "0.0"


def test_schedules(spark):
    after = datetime(2024, 2, 28, 23, 59, 30)
    assert bookkeeping.next_time("*/15 * * * *", after) == datetime(2024, 2, 29, 0, 0)
    assert bookkeeping.next_time("0 6 29 2 *", after) == datetime(2024, 2, 29, 6, 0)
    assert bookkeeping.next_time("30 4 1,15 * 5", after) == datetime(2024, 3, 1, 4, 30)  # a Friday and a first
    assert bookkeeping.next_time("0 0 * * 0", after) == datetime(2024, 3, 3) and bookkeeping.next_time("0 0 31 2 *", after) is None
    rows = spark.createDataFrame([("a", True, datetime(2024, 1, 1), "0 0 * * *"), ("b", False, datetime(2024, 1, 1), "0 0 * * *")], "source_id string, is_enabled boolean, next_run_at timestamp, cron_expression string")
    made = spark.createDataFrame([], "run_key string")
    requests, advanced = bookkeeping.poll(rows, made, F.lit("2024-01-05 10:00:00").cast("timestamp"))
    assert [r.run_key for r in requests.collect()] == ["a_20240101000000"]
    assert {r.source_id: r.next_run_at for r in advanced.collect()} == {"a": datetime(2024, 1, 6), "b": datetime(2024, 1, 1)}
    assert bookkeeping.poll(rows, requests, F.lit("2024-01-05 10:00:00").cast("timestamp"))[0].count() == 0


def test_texts(spark):
    row = one(
        spark, slug=texts.slugify(F.lit("  Été_" + "x" * 57 + " y z")), none=texts.slugify(F.lit("!!")), title=descriptions.title(F.lit("2m temp's é-x")), zone=catalog.zone(F.lit(-89), F.lit(-88), F.lit(0), F.lit(1)),
        station=descriptions.station_place(F.lit("De Bilt")), month=descriptions.month_of(F.lit("2024/3/9 x")), none_month=descriptions.month_of(F.lit("soon")), year=delimited.as_time(F.lit("1998")), dash=delimited.as_time(F.lit("1998-07")),
    )
    assert row.slug == "t_" + "x" * 57 and row.none == "export" and row.title == "2M Temp'S É-X" and row.zone == "Global"
    assert row.station == "De Bilt, Netherlands" and row.month == "March 2024" and row.none_month is None
    assert (row.year.year, row.dash.month) == (1998, 7)
    times = spark.createDataFrame([("200304",), ("2019.5",), ("48.0",), ("17",), ("2023",)], "t string").select(F.date_format(delimited.as_time(F.col("t")), "yyyy-MM-dd")).collect()
    assert [r[0] for r in times] == ["2004-03-20", "2019-05-01", None, None, "2023-01-01"]
    assert one(spark, x=scalars.rounded(F.lit(0.0625)), m=scalars.with_defaults(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3)))).m == {"a": 1, "b": 3}


def test_files_of_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,2,x\n-,4,y\n")
    (tmp_path / "b.csv").write_text("# note\nb;a;c\n7;8;z\n")
    rows = {(r.a, r.b, r.c) for r in delimited.read(spark, str(tmp_path)).collect()}
    assert rows == {("1", "2", "x"), ("-", "4", "y"), ("8", "7", "z")}


def record_file(path, values):
    """A file whose only record variable is a short of odd size."""
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: struct.pack(">i", len(s)) + pad(s.encode())
    t, x = values.shape
    dims = struct.pack(">ii", 10, 2) + name("time") + struct.pack(">i", 0) + name("cell") + struct.pack(">i", x)
    none = struct.pack(">ii", 0, 0)
    build = lambda begin: b"CDF\1" + struct.pack(">i", t) + dims + none + struct.pack(">ii", 11, 1) + name("v") + struct.pack(">iii", 2, 0, 1) + none + struct.pack(">iii", 3, 2 * x + -2 * x % 4, begin)
    path.write_bytes(build(len(build(0))) + values.astype(">i2").tobytes())


def test_one_record_variable_of_odd_size(spark, tmp_path):
    values = np.arange(12).reshape(4, 3)
    record_file(tmp_path / "s.nc", values)
    (row,) = grid.scan_netcdf(spark, str(tmp_path / "s.nc")).collect()
    assert row.error is None and row["values"] == values.ravel().tolist()


def test_tiled_image_is_an_error_row(spark, tmp_path):
    tags = [(256, 4, 4), (257, 4, 4), (259, 3, 1), (322, 4, 16), (323, 4, 16)]
    entries = b"".join(struct.pack("<HHII", tag, kind, 1, v) for tag, kind, v in tags)
    (tmp_path / "t.tif").write_bytes(b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + b"\0" * 4)
    (tmp_path / "u.tif").write_bytes(b"xx")
    found = grid.scan_geotiff(spark, str(tmp_path)).collect()
    assert len(found) == 2 and all(r.error for r in found)


def test_load_archives(spark, tmp_path):
    table = "station,time,v\nA,2020-01-01,1\nA,2020-01-02,3\nB,2020-01-01,5\n"
    folder = tmp_path / "in"
    folder.mkdir()
    with zipfile.ZipFile(folder / "a.zip", "w") as z:
        z.writestr("deep/../../x.csv", table)
        z.writestr("__MACOSX/y.csv", table)
        z.writestr("readme.md", "no")
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name in ("m.csv", ".hidden.csv"):
            info = tarfile.TarInfo(name)
            info.size = len(table)
            tar.addfile(info, io.BytesIO(table.encode()))
    (folder / "b.tar").write_bytes(raw.getvalue())
    (folder / "c.tar.gz").write_bytes(gzip.compress(raw.getvalue()))
    (folder / "d.csv.gz").write_bytes(gzip.compress(table.encode()))
    (folder / "e.zip").write_bytes(b"broken")
    (folder / "page").write_text("<html><body>no data</body></html>")
    (folder / "plain").write_text(table)
    record_file(folder / "g.nc", np.arange(12).reshape(4, 3))
    found = archives.load(spark, str(folder), str(tmp_path / "out")).collect()
    errors = {r.file.rsplit("/", 1)[-1]: r.error for r in found if r.error}
    assert set(errors) == {"e.zip", "page"}
    stations = [(r.place, r.mean) for r in found if r.variable == "v" and r.place in ("A", "B")]
    assert sorted(stations) == [("A", 2.0)] * 5 + [("B", 5.0)] * 5
    assert [r.mean for r in found if r.file.endswith("g.nc")] == [5.5]
    assert not (tmp_path.parent / "x.csv").exists()


def test_unpacking_is_bounded(tmp_path):
    packed = gzip.compress(b"0" * 1000)
    with pytest.raises(archives.TooLarge):
        for _, pieces in archives.members(io.BytesIO(packed), "x.csv.gz", most=10):
            list(pieces)


def test_an_archive_is_bounded_as_a_whole():
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for i in range(3):
            archive.writestr(f"{i}.csv", "0" * 600)
    with pytest.raises(archives.TooLarge):
        for _, pieces in archives.members(packed, "x.zip", most=1500):
            list(pieces)


def test_ids_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [("s", "v", f"f{i % 7}", c, "2020", "2020", "p", *[float(rng.integers(3))] * 8) for i in range(40) for c in ("station", "region")]
    schema = "source_id string, variable string, file string, station_col string, time_start string, time_end string, place string, " + ", ".join(f"{s} double" for s in ingest.STATS)
    found = []
    for n in (1, 5):
        chunks = spark.createDataFrame(rows, schema).repartition(n).withColumn("unit", F.lit("K"))
        found.append(sorted((r.chunk_id, r.file, r.station_col, r["mean"]) for r in ingest.described(chunks).collect()))
    assert found[0] == found[1] and len({r[0] for r in found[0]}) == 80


def test_ingest_into_a_collection(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("time,v\n2020-01-01,1\n2020-01-02,3\n")
    into = collection.Collection(spark, str(tmp_path / "store"))
    ingest.ingest(spark, str(tmp_path / "in"), "s1", into)
    ingest.ingest(spark, str(tmp_path / "in"), "s2", into)
    (tmp_path / "in" / "a.csv").write_text("time,v,w\n2020-01-01,1,2\n2020-01-02,3,4\n")
    ingest.ingest(spark, str(tmp_path / "in"), "s1", into, run="2")
    rows = into.read().orderBy("source_id", "chunk_index").collect()
    assert [(r.source_id, r.chunk_id, r.run) for r in rows] == [("s1", "s1_chunk_0", "2"), ("s1", "s1_chunk_1", "2"), ("s2", "s2_chunk_0", "1")]
    assert rows[0].text.startswith("Climate variable: V (v) | Dataset: s1 | Time: 2020-01-01 | Date: January 2020 | Mean: 2.00") and len(rows[0].embedding) == 256


def test_metadata_of_grids(spark, tmp_path):
    from isopleth.sources import metadata
    from tests.test_sources import netcdf

    netcdf(tmp_path / "a.nc", np.ones((3, 4, 5)))
    (tmp_path / "b.nc").write_bytes(b"no")
    found = {r.file.rsplit("/", 1)[-1]: r for r in metadata.scan_grids(spark, str(tmp_path)).collect()}
    a = found["a.nc"]
    assert (a.variables, a.units, a.lat_min, a.lat_max, a.lon_max, a.description) == (["air"], ["K"], 48.0, 49.0, 18.0, "Variables: air") and found["b.nc"].error
    assert metadata._dates(np.array([0.0, 36.0]), "hours since 2000-01-01 00:00:00") == ("2000-01-01", "2000-01-02")


def test_group_stats_are_exact(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([np.round(rng.normal(size=500), 1), rng.normal(size=77)])
    rows = [(i % 2, float(v)) for i, v in enumerate(values)] + [(2, 5.0), (3, float("nan"))]
    found = {r.k: r for r in summarize.group_stats8(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    assert set(found) == {0, 1, 2} and found[2].p10 == found[2].p90 == 5.0 and found[2].std == 0
    for k in (0, 1):
        own = np.array([v for j, v in rows if j == k])
        assert (found[k].p10, found[k].median, found[k].p90, found[k].std) == tuple(pytest.approx(x, abs=1e-6) for x in (*np.percentile(own, [10, 50, 90]), own.std()))


def test_group_stats_far_above_their_deviation(spark):
    values = 101325 + np.random.default_rng(0).normal(size=20000) * 0.005
    rows = spark.createDataFrame([(None if i % 4 else "a", float(v)) for i, v in enumerate(values)], "k string, v double").repartition(5)
    found = {r.k: r for r in summarize.group_stats8(rows, ["k"], "v").collect()}
    for k, own in (("a", values[::4]), (None, np.delete(values, np.s_[::4]))):
        assert [found[k][c] for c in ("mean", "std", "p10", "median", "p90", "n_cells")] == [pytest.approx(x, abs=1.1e-6) for x in (own.mean(), own.std(), *np.percentile(own, [10, 50, 90]), len(own))]
    weighted = summarize.group_stats8(spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1), ("a", float("inf"), 9)], "k string, v double, c int"), ["k"], "v", "c").first()
    assert (weighted["mean"], weighted.n_cells, weighted.median, weighted.p90) == (2.0, 4, 1.0, 3.8)


def test_contexts_are_written_once(spark):
    entries = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "n int, dataset_name string")
    found = {r.n: r.context for r in answer.dataset_contexts(entries, lambda prompt: prompt[:24]).collect()}
    assert found == {1: "Describe the dataset a i", 2: "Describe the dataset a i", 3: None}


def test_whole_plan(spark):
    from isopleth.functions import models

    rows = [(i, f"{w} statistics of station {i}", f"s{i % 6}", w, f"d{i % 2}", i == 3) for i, w in enumerate(["drought", "rain", "wind", "heat"] * 10)]
    chunks = spark.createDataFrame(rows, "id long, text string, source string, variable string, dataset string, is_summary boolean").withColumn("embedding", models.embedded(F.col("text")))
    questions = spark.createDataFrame([(1, "compare drought and wind speed statistics"), (2, "rain")], "query_id long, question string")
    variants = answer.expanded(questions, lambda prompt: "drought statistics please\nshort\nwind statistics, please")
    assert [(r.query_id, r.n) for r in variants.orderBy("query_id", "n").collect()] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    found = answer.search_all(questions, chunks, variants, top_k=5).orderBy("query_id", "rank").collect()
    first = [r for r in found if r.query_id == 1]
    assert [r.rank for r in first] == [1, 2, 3, 4, 5] and {r.variable for r in first} <= {"drought", "wind", "rain", "heat"} and len({r.source for r in first}) >= 4
    again = answer.with_retry(spark.createDataFrame(first).where("rank < 3"), spark.createDataFrame(found).where("query_id = 1")).orderBy("rank").collect()
    assert [r.rank for r in again] == list(range(1, len(again) + 1)) and len({(r.source, r.variable) for r in again}) == len(again)


def test_orders_of_lists_have_no_single_task(spark, capsys):
    __import__("__spark_entry__").queries()["orders_of_lists"](spark, "/root/testdata/sf0.001").explain()
    assert "SinglePartition" not in capsys.readouterr().out


def test_group_stats_take_tasks_by_the_number_of_rows(spark, tmp_path, monkeypatch):
    """However few shuffle partitions there are, no task sorts much more than ROWS rows, and results stay."""
    monkeypatch.setattr(summarize, "ROWS", 1000, raising=False)
    monkeypatch.setattr(summarize, "folder", lambda spark, kind: str(tmp_path / kind))
    rows = spark.range(30_000).select((F.col("id") % 2).alias("k"), (F.col("id") * 0.5).alias("v"))
    found = {r.k: r for r in summarize.group_stats8(rows, ["k"], "v").collect()}
    assert [(found[k].n_cells, found[k].median, found[k].min, found[k].max) for k in (0, 1)] == [(15000, 7499.5, 0.0, 14999.0), (15000, 7500.0, 0.5, 14999.5)]
    assert max(r.n for r in spark.read.parquet(str(tmp_path / "blocks")).groupBy(F.input_file_name()).agg(F.sum("_n").alias("n")).collect()) <= 2000
