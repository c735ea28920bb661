"""Streams with state and event-time timers: silence of sources and rates of attempts, with the rows that the batch functions give."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state(spark: SparkSession) -> None:
    """Sets the state store that timers need; to be called before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class _Silence(StatefulProcessor):
    """Keeps a key's heartbeats that may still matter, in milliseconds, and a timer for the oldest.

    A timer goes off once no earlier heartbeat can come. Then the oldest has been followed in time or not.
    """

    def __init__(self, wait: int, name: str):
        self.wait, self.name = wait, name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.times = handle, handle.getListState("times", "at long")

    def _put(self, times: list[int]) -> None:
        self.times.clear()
        if times:
            self.times.put([(t,) for t in times])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        known = {t for (t,) in self.times.get()}
        new = {int(t) for frame in rows for t in frame["at_"]} - known
        if new:
            if not known or min(new) < min(known):
                self.handle.registerTimer(min(new) + self.wait)
            self._put(sorted(known | new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        end, times, silent = timerValues.getCurrentWatermarkInMs(), sorted(t for (t,) in self.times.get()), []
        # all that is due by now: a timer that is set here only goes off with the next batch, and only before the watermark
        while times and times[0] + self.wait < end:
            due = times.pop(0)
            if not times or times[0] > due + self.wait:
                silent.append(due)
        self._put(times)
        if times:
            self.handle.registerTimer(times[0] + self.wait)
        return iter([pd.DataFrame({self.name: [key[0]] * len(silent), "last_": silent})] if silent else [])

    def close(self) -> None:
        pass


def stalls(heartbeats: DataFrame, key: str, time: str, minutes: int = 5, late: str = "1 minute", until=None) -> DataFrame:
    """Silences: key, last_seen, stalled_at, for each heartbeat that none follows within `minutes`.

    On a stream a silence is told once the watermark has passed stalled_at. In a batch all rows are there, and those count
    whose stalled_at is before `until`, by default the last heartbeat of all less `late`, which is where a stream's
    watermark ends. Times count in milliseconds; repeated heartbeats count once.
    """
    name = f"`{key}` {heartbeats.schema[key].dataType.simpleString()}"
    millis = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 1000)
    wait = minutes * 60_000
    if heartbeats.isStreaming:
        timed = heartbeats.select(key, F.col(time).cast("timestamp").alias("time_"), millis.alias("at_")).withWatermark("time_", late)
        found = timed.groupBy(key).transformWithStateInPandas(_Silence(wait, key), f"{name}, last_ long", "Append", "EventTime")
    else:
        rows = heartbeats.where(F.col(time).isNotNull()).select(key, millis.alias("last_")).distinct()
        following = rows.withColumn("next_", F.lead("last_").over(Window.partitionBy(key).orderBy("last_")))
        end = F.lit(until).cast("timestamp") if until is not None else F.max(F.col(time).cast("timestamp")) - F.expr(f"INTERVAL {late}")
        limit = heartbeats.select(F.floor(F.unix_micros(end) / 1000).alias("end_"))
        limit = limit.limit(1) if until is not None else limit
        found = following.crossJoin(F.broadcast(limit)).where((F.col("next_").isNull() | (F.col("next_") > F.col("last_") + wait)) & (F.col("last_") + wait < F.col("end_")))  # one row
    return found.select(key, F.timestamp_millis("last_").alias("last_seen"), F.timestamp_millis(F.col("last_") + wait).alias("stalled_at"))


class _Rate(StatefulProcessor):
    """Keeps a key's attempts of the last seconds, and tells about each once no earlier one can come."""

    def __init__(self, micros: int, most: int, name: str, id_col: str):
        self.micros, self.most, self.name, self.id_col = micros, most, name, id_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.attempts = handle, handle.getListState("attempts", "at long, id long, told boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        new = [(int(a), int(i), False) for frame in rows for a, i in zip(frame["at_"], frame[self.id_col])]
        if new:
            self.attempts.appendList(new)
            for due in {-(-a // 1000) for a, _, _ in new}:
                self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        attempts = sorted(tuple(r) for r in self.attempts.get())
        out = []
        for at, number, told in attempts:
            if not told and at <= due:
                recent = [a for a, _, _ in attempts if at - self.micros <= a <= at]
                blocked = len(recent) >= self.most
                out.append((key[0], number, len(recent), blocked, -(-(recent[0] + self.micros - at) // 1_000_000) if blocked else None))
        kept = [(a, i, told or a <= due) for a, i, told in attempts if a >= due - self.micros or a > due]
        self.attempts.clear()
        if kept:
            self.attempts.put(kept)
        frame = pd.DataFrame(out, columns=[self.name, self.id_col, "n_recent", "blocked", "retry_after"])
        return iter([frame.astype({"retry_after": "Int64"})] if out else [])

    def close(self) -> None:
        pass


def attempt_rates(attempts: DataFrame, key: str, time: str, id_col: str, seconds: int, most: int, late: str = "1 minute") -> DataFrame:
    """A stream of attempts with n_recent, blocked and retry_after, as relate.sliding_count gives them for a batch: key, id, these.

    An attempt is told about when the watermark has passed it, as only then all attempts before it are there. State is
    a key's attempts of the last `seconds` and of the time that the watermark lags. Ids are whole numbers.
    """
    timed = attempts.select(key, F.col(id_col).cast("long").alias(id_col), F.col(time).cast("timestamp").alias("time_"), F.unix_micros(F.col(time).cast("timestamp")).alias("at_")).withWatermark("time_", late)
    schema = f"`{key}` {attempts.schema[key].dataType.simpleString()}, `{id_col}` long, n_recent long, blocked boolean, retry_after long"
    return timed.groupBy(key).transformWithStateInPandas(_Rate(seconds * 1_000_000, most, key, id_col), schema, "Append", "EventTime")
