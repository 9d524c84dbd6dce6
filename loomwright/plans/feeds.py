"""Queries that take the given tables as feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import feeds


def stream_new_chunks(spark, folder):
    return feeds.new_chunks(spark, f"{folder}/chunks.parquet").select("id", "manual_id", "page", "ordinal", "extraction", F.length("text").alias("chars"))


def stream_latest_feedback(spark, folder):
    return feeds.latest_feedback(spark, f"{folder}/feedback.parquet")


def stream_hourly_events(spark, folder):
    return feeds.hourly_events(spark, f"{folder}/events.parquet")


QUERIES = {q.__name__: q for q in (stream_new_chunks, stream_latest_feedback, stream_hourly_events)}
ORACLE = {
    "stream_new_chunks": "SELECT id, manual_id, page, ordinal, extraction, CAST(length(text) AS INTEGER) AS chars FROM (SELECT DISTINCT * FROM chunks)",
    "stream_latest_feedback": "SELECT DISTINCT * FROM feedback QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC NULLS LAST, verdict DESC NULLS LAST, note DESC NULLS LAST) = 1",
    "stream_hourly_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
}
