"""Registered streaming queries over the events table, read as a stream; each runs over all that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import jobs
from . import sql as S
from . import views as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    return shared_dir(spark, "stream")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of the events table as a stream: the same view, with the file source below it."""
    schema = V.read(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return V.audit_of(events)


def _in_batches(spark: SparkSession, sf_dir: str, batches: int = 4) -> DataFrame:
    """The same rows as a stream of several batches in the order of time; last rows, long after all others, end what is open.

    They are such that every job's filters let them through, as Spark filters before it looks at event times, and stay open themselves.
    """
    events, path = V.read(spark, sf_dir, "events"), _folder(spark)
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    ends = [lo + (hi - lo) * i / batches for i in range(batches + 1)]
    for i in range(batches):
        part = events.filter((F.col("ts") >= F.lit(ends[i])) & ((F.col("ts") < F.lit(ends[i + 1])) | F.lit(i == batches - 1)))
        part.coalesce(1).write.mode("append").parquet(path)
    last = events.orderBy(F.desc("ts"), "event_id").limit(1)
    for later in ("60 DAYS", "60 DAYS 30 MINUTES"):  # what the first one ends goes through a second operator with the next
        rows = last.withColumns({"ts": F.col("ts") + F.expr(f"INTERVAL {later}"), "event_type": F.lit("view"), "event_id": F.explode(F.array(F.lit(3), F.lit(4)).cast("array<bigint>"))})  # a turn's summary and a check
        rows.select(events.columns).coalesce(1).write.mode("append").parquet(path)
    return V.audit_of(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path))


def stream_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several batches through two stateful operators; the rows of a minute add up."""
    rows = jobs.timeline(_in_batches(spark, sf_dir).withWatermark("ts_utc", jobs.WATERMARK), "1 day")
    out = jobs.run_once(rows, _folder(spark), "append")
    return out.groupBy("minute").agg(*[F.sum(n).alias(n) for n in ("requests", "blocked", "redacted", "flagged")])


def stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of every day as the last of several batches left them."""
    path, last = _folder(spark), V.read(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    writer = jobs.snapshots(_in_batches(spark, sf_dir).withWatermark("ts_utc", jobs.WATERMARK), path)
    query = writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    history = spark.read.parquet(f"{path}/metrics/history")
    days = spark.read.parquet(f"{path}/totals").withColumn("last", F.max("epoch").over(Window.partitionBy("date"))).filter("epoch = last")
    return days.filter(F.col("date") <= F.to_date(F.lit(last))).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "requests", *jobs.OUTCOMES.values()).crossJoin(history.agg((F.count("*") >= 4).alias("has_history")))  # one row


def stream_minute_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.minute_decisions(_stream(spark, sf_dir).withWatermark("ts_utc", jobs.WATERMARK))
    out = jobs.run_once(rows, _folder(spark), "complete")
    return out.select(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "rows", "blocked", "redacted", "flagged")


def stream_daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.run_once(jobs.daily_usage(_stream(spark, sf_dir).withWatermark("ts_utc", jobs.WATERMARK)), _folder(spark), "complete")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "caller_id", "tokens", F.round("cost", 6).alias("cost"))


def stream_session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.run_once(jobs.session_totals(_in_batches(spark, sf_dir).withWatermark("ts_utc", jobs.WATERMARK)), _folder(spark), "append")
    return out.select("conversation_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("started"), "rows", F.round("cost", 6).alias("cost"), "last_step")


def stream_live_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.run_once(jobs.live_turns(_stream(spark, sf_dir).withWatermark("ts_utc", jobs.WATERMARK)), _folder(spark), "update", keys=("request_id",))
    return V.rounded(out.select("request_id", "state", "pre_ms", "model_ms", "post_ms"))


def stream_rolling_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _stream(spark, sf_dir).filter("caller_id IS NOT NULL").withWatermark("ts_utc", jobs.WATERMARK)
    return jobs.run_once(jobs.rolling_budget(requests, 1), _folder(spark), "append")


for _f in (stream_timeline, stream_snapshots, stream_minute_decisions, stream_daily_usage, stream_session_totals, stream_live_turns, stream_rolling_budget):
    QUERIES[_f.__name__] = _f

ORACLES["stream_minute_decisions"] = S.with_audit("SELECT strftime(ts_utc, '%Y-%m-%d %H:%M') AS minute, count(*) AS rows, count(*) FILTER (WHERE action = 'block') AS blocked, count(*) FILTER (WHERE action = 'redact') AS redacted, count(*) FILTER (WHERE action = 'flag') AS flagged FROM checks GROUP BY 1", S.CHECK_ROWS)
ORACLES["stream_daily_usage"] = S.with_audit("SELECT strftime(ts_utc, '%Y-%m-%d') AS day, caller_id, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost FROM audit WHERE \"check\" = 'turn_summary' AND caller_id IS NOT NULL GROUP BY 1, 2")
ORACLES["stream_session_totals"] = S.with_audit(
    """SELECT conversation_id, strftime(min(ts_utc), '%Y-%m-%d %H:%M:%S.%f') AS started, count(*) AS rows, round(sum(cost), 6) AS cost, max(step) AS last_step FROM (SELECT *, sum(new) OVER (PARTITION BY conversation_id ORDER BY ts_utc, id) AS session
  FROM (SELECT *, CASE WHEN ts_utc - lag(ts_utc) OVER (PARTITION BY conversation_id ORDER BY ts_utc, id) < INTERVAL 7 DAYS THEN 0 ELSE 1 END AS new FROM audit WHERE conversation_id IS NOT NULL)) GROUP BY conversation_id, session"""
)
ORACLES["stream_snapshots"] = S.with_audit("SELECT strftime(date, '%Y-%m-%d') AS date, count(*) AS requests, " + ", ".join(f"count(*) FILTER (WHERE strength = {k}) AS {n}" for k, n in enumerate(jobs.OUTCOMES.values())) + ", true AS has_history FROM (SELECT date, request_id, max(strength) AS strength FROM checks WHERE request_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1", S.CHECK_ROWS)
ORACLES["stream_timeline"] = S.with_audit("SELECT strftime(date_trunc('minute', first_ts), '%Y-%m-%dT%H:%M:00Z') AS minute, count(*) AS requests, count(*) FILTER (WHERE strength = 3) AS blocked, count(*) FILTER (WHERE strength = 2) AS redacted, count(*) FILTER (WHERE strength = 1) AS flagged FROM requests GROUP BY 1", S.REQUESTS)
#: Of all rows in one batch; a turn is abandoned that has no end when the watermark is ten minutes after its first row.
ORACLES["stream_live_turns"] = S.with_audit(
    """SELECT request_id, CASE WHEN failed THEN 'failed' WHEN reply OR strength = 3 THEN ['allow', 'flag', 'redact', 'block'][strength + 1] WHEN first_ts + INTERVAL 10 MINUTES <= (SELECT max(ts_utc) FROM audit) - INTERVAL 10 MINUTES THEN 'abandoned' ELSE 'running' END AS state,
  round(pre, 6) AS pre_ms, round(model, 6) AS model_ms, round(post, 6) AS post_ms FROM (SELECT request_id, min(ts_utc) AS first_ts, bool_or("check" = 'upstream_unavailable') AS failed, bool_or(s AND NOT r) AS reply, CAST(coalesce(max(CASE WHEN s THEN strength END), 0) AS INTEGER) AS strength,
  coalesce(sum(overhead_ms) FILTER (WHERE s AND r), 0.0) AS pre, coalesce(sum(upstream_latency_ms) FILTER (WHERE s AND NOT r), 0.0) AS model, coalesce(sum(overhead_ms) FILTER (WHERE s AND NOT r), 0.0) AS post
  FROM (SELECT *, "check" = 'turn_summary' AS s, coalesce(at_request, false) AS r FROM audit WHERE request_id IS NOT NULL) GROUP BY 1)"""
)
ORACLES["stream_rolling_budget"] = S.with_audit(
    """SELECT caller_id, id, verdict FROM walk WHERE n > 0""",
    """, asked AS (SELECT caller_id, id, ts_utc, row_number() OVER (PARTITION BY caller_id ORDER BY ts_utc, id) AS n FROM audit WHERE caller_id IS NOT NULL),
walk AS (SELECT DISTINCT caller_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS TIMESTAMP) AS last, '' AS verdict FROM asked
UNION ALL SELECT a.caller_id, a.n, a.id, CASE WHEN w.last > a.ts_utc - INTERVAL 60 SECONDS THEN w.last ELSE a.ts_utc END, CASE WHEN w.last > a.ts_utc - INTERVAL 60 SECONDS THEN 'block' ELSE 'allow' END FROM walk w JOIN asked a ON a.caller_id = w.caller_id AND a.n = w.n + 1)""",
).replace("WITH ", "WITH RECURSIVE ", 1)
