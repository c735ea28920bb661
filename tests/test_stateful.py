"""Streams with timers against the same questions asked of a batch."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from isopleth.operators import relate
from isopleth.streaming import events, stateful

START = datetime.datetime(2024, 1, 1)


def write(spark, folder, rows, schema, files):
    """Rows in order, in several files, so that a stream takes them in several batches."""
    folder.mkdir()
    step = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.parquet(str(folder / f"{i:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


@pytest.fixture(autouse=True)
def state(spark):
    stateful.use_state(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stalls_equal_the_batch(spark, tmp_path):
    rng, rows, at = random.Random(1), [], 0
    for _ in range(120):
        at += rng.choice([20, 60, 200, 400])
        rows.append((f"s{rng.randrange(4)}", START + datetime.timedelta(seconds=at - rng.choice([0, 0, 30, 50]), milliseconds=rng.randrange(3))))
    rows += [rows[5], ("once", START + datetime.timedelta(seconds=1)), ("end", START + datetime.timedelta(seconds=at))]
    rows.sort(key=lambda r: (r[1] - START).total_seconds() // 60)  # out of order within a minute
    schema = "source string, ts timestamp"
    stream = write(spark, tmp_path / "in", rows, schema, 6)
    found = events.run_available(stateful.stalls(stream, "source", "ts", 5, "2 minutes"), "stalled", str(tmp_path / "done")).collect()
    batch = stateful.stalls(spark.createDataFrame(rows, schema), "source", "ts", 5, "2 minutes").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, batch)) and len(batch) > 20
    by_hand = []
    for source in {s for s, _ in rows}:
        times = sorted({t.replace(microsecond=t.microsecond // 1000 * 1000) for s, t in rows if s == source})
        end = max(t for _, t in rows) - datetime.timedelta(minutes=2)
        for t, after in zip(times, [*times[1:], None]):
            due = t + datetime.timedelta(minutes=5)
            if (after is None or after > due) and due < end.replace(microsecond=end.microsecond // 1000 * 1000):
                by_hand.append((source, t, due))
    assert sorted(by_hand) == sorted(map(tuple, batch))


def test_rates_equal_the_batch(spark, tmp_path):
    rng, rows, at = random.Random(2), [], 0
    for i in range(150):
        at += rng.choice([0, 1, 5, 40])
        rows.append((i, "hot" if i % 3 == 0 else f"ip{rng.randrange(3)}", START + datetime.timedelta(seconds=at, microseconds=rng.choice([0, 1, 999_999]))))
    schema = "id long, ip string, ts timestamp"
    stream = write(spark, tmp_path / "in", rows, schema, 5)
    found = events.run_available(stateful.attempt_rates(stream, "ip", "ts", "id", 60, 5, "10 seconds"), "rates", str(tmp_path / "done")).collect()
    last = max(t for *_, t in rows) - datetime.timedelta(seconds=10)
    batch = relate.sliding_count(spark.createDataFrame(rows, schema), "ip", "ts", 60, 5).where(F.col("ts") <= F.lit(last - datetime.timedelta(milliseconds=1))).select("ip", "id", "n_recent", "blocked", "retry_after").collect()
    told = {r.id: tuple(r) for r in found}
    assert len(found) == len(told) and all(told[r.id] == tuple(r) for r in batch) and len(batch) > 130
    assert any(r.blocked for r in batch) and len(told) <= len(batch) + 3
