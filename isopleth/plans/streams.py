"""Registered queries of event-time windows; streams give the same final rows (see the tests)."""

from pyspark.sql import functions as F

from isopleth.plans.registry import register
from isopleth.streaming import events as streams


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@register("tumbling_window", "SELECT date_trunc('day', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf_dir):
    """Tumbling days per event type."""
    return streams.tumbling(_events(spark, sf_dir), "ts", "1 day", "event_type", "value").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("sliding_window", "SELECT date_trunc('day', ts) - to_days(CAST(i AS INTEGER)) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events, range(0, 2) t(i) GROUP BY 1, 2")
def sliding_window(spark, sf_dir):
    """Two-day windows that slide by a day."""
    return streams.sliding(_events(spark, sf_dir), "ts", "2 days", "1 day", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("session_window", """WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM m)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", user_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, session""")
def session_window(spark, sf_dir):
    """Sessions of users with gaps of six hours."""
    found = streams.sessions(_events(spark, sf_dir), "ts", "6 hours", "user_id")
    return found.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@register("dedup_watermark", "SELECT DISTINCT user_id, event_type FROM events")
def dedup_watermark(spark, sf_dir):
    """One event per user and type."""
    return streams.distinct_events(_events(spark, sf_dir), "ts", ["user_id", "event_type"]).select("user_id", "event_type")
