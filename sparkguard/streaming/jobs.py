"""Structured Streaming forms of the live views, budgets and scans.

Every job takes a streaming DataFrame of audit rows (or texts) and returns one; the caller starts it. State is dropped by
watermark or timer; use the RocksDB state store for large key sets.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import scans, tool_args
from ..schemas import ACTIONS, AUDIT, OUTCOMES, TURN_SUMMARY
from ..sources.audit import derive
from .state import TURN, LiveTurns, RollingBudget, by_key, use_rocksdb

WATERMARK = "10 minutes"


def tail(spark: SparkSession, path: str, watermark: str = WATERMARK, **options) -> DataFrame:
    """New audit rows of the day files, derived; rows that are read twice within the watermark come once."""
    raw = spark.readStream.schema(AUDIT).options(**options).json(f"{path}/audit-*.jsonl")
    return once(derive(raw.filter("id IS NOT NULL")), watermark)


def once(rows: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    return rows.withWatermark("ts_utc", watermark).dropDuplicatesWithinWatermark(["id"])


def minute_decisions(rows: DataFrame) -> DataFrame:
    """Check rows per minute and action; requests by outcome are in timeline()."""
    checks = rows.filter(~F.col("is_system_event"))
    counts = checks.groupBy(F.window("ts_utc", "1 minute")).agg(F.count("*").alias("rows"), *[F.count_if(F.col("action") == a).alias(n) for a, n in (("block", "blocked"), ("redact", "redacted"), ("flag", "flagged"))])
    return counts.select(F.col("window.start").alias("minute"), "rows", "blocked", "redacted", "flagged")


def daily_usage(rows: DataFrame) -> DataFrame:
    """Tokens and cost per caller and UTC day over the usage of each request's reply row."""
    replies = rows.filter((F.col("check") == TURN_SUMMARY) & F.col("caller_id").isNotNull())
    return replies.groupBy(F.window("ts_utc", "1 day"), "caller_id").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost")).select(F.col("window.start").alias("day"), "caller_id", "tokens", "cost")


#: A request ends when it has had no row for so long; a conversation too.
IDLE = "1 hour"


def session_totals(rows: DataFrame, idle: str = "7 days") -> DataFrame:
    """Turn rows and cost of each conversation; it ends, and its state goes, after it has been idle for so long."""
    turn = rows.filter((F.col("check") == TURN_SUMMARY) & F.col("conversation_id").isNotNull())
    totals = turn.groupBy(F.session_window("ts_utc", idle), "conversation_id").agg(F.count("*").alias("rows"), F.sum("cost").alias("cost"), F.max("step").alias("last_step"))
    return totals.select("conversation_id", F.col("session_window.start").alias("started"), "rows", "cost", "last_step")


def request_outcomes(rows: DataFrame, idle: str = IDLE) -> DataFrame:
    """request_id, minute of the first row and strongest action of each request, once, when it has been idle for so long; event time is its end."""
    checks = rows.filter(~F.col("is_system_event") & F.col("request_id").isNotNull())
    ended = checks.groupBy(F.session_window("ts_utc", idle), "request_id").agg(F.min("ts_utc").alias("first_ts"), F.max(C.strength()).alias("strength"))
    return ended.select(F.window_time("session_window").alias("ended"), "request_id", C.minute_text(F.col("first_ts")).alias("minute"), C.action_of(F.col("strength")).alias("action"))


def timeline(rows: DataFrame, idle: str = IDLE, spread: str = "1 hour") -> DataFrame:
    """Requests per minute of their first row by final outcome: one stateful operator feeds another under one watermark.

    In append mode. Requests of a minute that end in different windows of length `spread` give a row each; their counts add up.
    """
    counts = request_outcomes(rows, idle).groupBy(F.window("ended", spread), "minute").agg(F.count("*").alias("requests"), *[F.count_if(F.col("action") == a).alias(n) for a, n in (("block", "blocked"), ("redact", "redacted"), ("flag", "flagged"))])
    return counts.select("minute", "requests", "blocked", "redacted", "flagged")


#: Groups of requests that are folded together.
BUCKETS = 512


def live_turns(rows: DataFrame, minutes: int = 10) -> DataFrame:
    """Each request folded into its stages (see state.LiveTurns); in update mode."""
    request = rows.filter("request_id IS NOT NULL").select("request_id", "ts_utc", "check", "checkpoint", C.strength().alias("strength"), "overhead_ms", "upstream_latency_ms", F.pmod(F.xxhash64("request_id"), F.lit(BUCKETS)).alias("bucket"))
    return by_key(request, "bucket", LiveTurns(minutes), TURN, "Update")


def rolling_budget(requests: DataFrame, per_minute: int) -> DataFrame:
    """requests(caller_id, id, ts_utc) with verdicts; only allowed ones of the last 60 s count.

    A batch is judged in the order of time; a request that comes in a later batch than a younger one is judged when it comes.
    """
    return by_key(requests.select("caller_id", "id", "ts_utc"), "caller_id", RollingBudget(per_minute), "caller_id string, id long, verdict string", "Append")


def guard_scan(texts: DataFrame, feed: list[tuple] = (), types: tuple[str, ...] = scans.PII_TYPES) -> DataFrame:
    """Arriving texts with redactions and the feed's first signature that matches (null: none); stateless."""
    return scans.match_signatures(scans.find_pii(texts, types=types), list(feed))


def guard_calls(calls: DataFrame, allowed_root: str | None = None, max_command_chars: int = 2000) -> DataFrame:
    """The string arguments of arriving tool calls with the first shell, SQL, path or deserialization rule that holds; stateless."""
    return tool_args.scan_args(tool_args.arg_hints(tool_args.explode_args(calls)), allowed_root, max_command_chars)


def each_batch_with_feed(texts: DataFrame, load_feed: Callable[[], list[tuple]], write: Callable[[DataFrame, int], None]):
    """A foreachBatch writer that scans every batch with the newest feed; a feed that fails to load leaves the last good one."""
    good: list[list[tuple]] = []

    def run(batch: DataFrame, epoch: int) -> None:
        try:
            feed = load_feed()
            for s in feed:
                re.compile(s[3])
            good[:] = [feed]
        except Exception:
            if not good:
                raise
        write(scans.scan_signatures(batch, good[0]), epoch)

    return texts.writeStream.foreachBatch(run)


def store(rows: DataFrame, path: str):
    """A writer of rows below path, one folder per UTC day; the sink's log makes a batch that runs again count once."""
    return rows.writeStream.format("parquet").option("path", path).partitionBy("date")


class OutcomeChanges:
    """Steps of a request's strongest action on a day: before (null for a new request) and after, which is one more; a batch may have several."""

    SCHEMA = "date date, request_id string, before int, after int"


def outcome_changes(rows: DataFrame) -> DataFrame:
    """Each step that a request's strongest action takes, once: an action stands for all steps up to its strength, and known ones are dropped by Spark's own state."""
    use_rocksdb(rows.sparkSession)
    checks = rows.filter(~F.col("is_system_event") & F.col("request_id").isNotNull())
    steps = checks.select("date", "request_id", F.window("ts_utc", "1 day").alias("day"), F.explode(F.sequence(F.lit(0), C.strength())).alias("after"))  # state goes when the watermark passes the day
    return steps.dropDuplicates(["date", "request_id", "day", "after"]).select("date", "request_id", F.when(F.col("after") > 0, F.col("after") - 1).alias("before"), "after")


#: Epochs of totals that are kept for a batch that runs again.
KEPT_EPOCHS = 8


def add_changes(changes: DataFrame, epoch: int, path: str) -> DataFrame:
    """Totals of each day at an epoch: those of the epoch before and what changed. A batch that runs again replaces its epoch."""
    from ..sources.audit import remove

    spark = changes.sparkSession
    count = lambda strength: F.when(F.col("after") == strength, 1).otherwise(0) - F.when(F.col("before") == strength, 1).otherwise(0)
    delta = changes.groupBy("date").agg(F.count_if(F.col("before").isNull()).alias("requests"), *[F.sum(count(k)).alias(OUTCOMES[a]) for k, a in enumerate(ACTIONS)])
    names = delta.columns[1:]
    if epoch:
        delta = spark.read.parquet(f"{path}/totals/epoch={epoch - 1}").unionByName(delta)
    delta.groupBy("date").agg(*[F.sum(n).alias(n) for n in names]).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals/epoch={epoch}")
    remove(spark, f"{path}/totals/epoch={epoch - KEPT_EPOCHS}")
    return spark.read.parquet(f"{path}/totals/epoch={epoch}")


def snapshots(rows: DataFrame, path: str, seconds: int = 5):
    """A writer that, for every batch, replaces the totals of the newest UTC day and adds a row to their history.

    Work depends on the requests of the batch: what is known of a request is in the state, what is known of a day in the totals of the epoch
    before. Every epoch has folders of its own, so that a batch that runs again changes nothing.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        days = add_changes(batch, epoch, path)
        newest = days.orderBy(F.desc("date")).limit(1).withColumn("taken_at", F.current_timestamp())
        newest.coalesce(1).write.mode("overwrite").json(f"{path}/metrics/latest")
        newest.coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics/history/epoch={epoch}")

    return outcome_changes(rows).writeStream.foreachBatch(run).outputMode("append").trigger(processingTime=f"{seconds} seconds")


def run_once(stream: DataFrame, path: str, mode: str = "append", keys: tuple[str, ...] = (), trigger: dict | None = None) -> DataFrame:
    """Run a stream over what is there now and read its result: in complete mode that of the last batch, in update mode the last row of each key.

    Every batch has a folder of its own, which a batch that is run again replaces.
    """
    spark = stream.sparkSession
    started = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(**(trigger or {"availableNow": True}))
    if mode == "append":
        query = started.format("parquet").option("path", f"{path}/out").start()
    else:
        query = started.foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(f"{path}/out/epoch={e}")).outputMode(mode).start()
    query.awaitTermination()
    if not query.lastProgress and mode != "append":
        return spark.createDataFrame([], stream.schema)
    out = spark.read.parquet(f"{path}/out")
    if mode == "complete":
        return out.filter(F.col("epoch") == out.agg(F.max("epoch")).first()[0]).drop("epoch")
    if keys:
        last = out.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "epoch").alias("row"))
        return last.select("row.*")
    return out
