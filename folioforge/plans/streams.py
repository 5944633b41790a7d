"""Streams over the given tables, drained once; each equals a batch statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.plans.catalog import query
from folioforge.streaming import intake


@query("SELECT sha256(text) AS sha, count(DISTINCT sha256(text)) AS kept FROM documents GROUP BY sha256(text)")
def stream_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct text once, whichever copy came first."""
    out = intake.drained(intake.first_of_each(intake.files(spark, sf_dir, "documents")).select("sha"), "intake")
    return out.groupBy("sha").agg(F.count("*").alias("kept"))


@query("SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = intake.timed(intake.files(spark, sf_dir, "events"))
    per = events.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = intake.drained(per, "daily", "complete")
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '8 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, strftime(max(ts) + INTERVAL '8 hours', '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions end after eight idle hours."""
    out = intake.drained(intake.sessions(intake.timed(intake.files(spark, sf_dir, "events"))), "sessions", "complete")
    at = "yyyy-MM-dd HH:mm:ss"
    return out.select("user_id", F.date_format("start", at).alias("began"), F.date_format("end", at).alias("ended"), "n")


@query("SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'empty' ELSE 'too long' END AS reason FROM documents WHERE length(trim(text)) = 0 OR length(text) > 10000")
def stream_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sink for refused documents receives."""
    _, refused = intake.rejected(intake.files(spark, sf_dir, "documents"), 10_000)
    return intake.drained(refused.select("doc_id", "reason"), "refused")


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, least(60.0 * power(2, least(count(*) FILTER (event_type = 'error'), 20)), 21600.0) AS wait FROM events GROUP BY user_id")
def stream_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures per key as streaming state, and how long the next attempt waits."""
    failures = intake.files(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"))
    out = intake.drained(failures, "retries", "complete")
    wait = F.least(60.0 * F.pow(F.lit(2.0), F.least(F.col("failures"), F.lit(20))), F.lit(21600.0))
    return out.select("user_id", "failures", wait.alias("wait"))
