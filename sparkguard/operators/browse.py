"""Browsing the audit log: filters, pages, feeds and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import JUDGE, TURN_SUMMARY


def search(audit: DataFrame, since: str | None = None, until: str | None = None, **equal: str | None) -> DataFrame:
    """Rows with the given caller_id, check, action and checkpoint, between since and until (both inclusive)."""
    for name, value in equal.items():
        if value is not None:
            audit = audit.filter(F.col(name) == value)
    if since:
        audit = audit.filter(F.col("ts_utc") >= F.try_to_timestamp(F.lit(since)))
    return audit.filter(F.col("ts_utc") <= F.try_to_timestamp(F.lit(until))) if until else audit


def page(audit: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page, newest first; page_with_total() also counts."""
    if offset < 0 or not 1 <= limit <= 1000:
        raise ValueError("offset must be at least 0 and limit from 1 to 1000")
    return audit.orderBy(F.desc("id")).offset(offset).limit(limit)


def page_with_total(audit: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page with the number of all rows that match in total, which a count of its own finds."""
    total = audit.agg(F.count("*").alias("total"))
    return page(audit, offset, limit).crossJoin(F.broadcast(total))  # one row


def threat_feed(audit: DataFrame, n: int = 30, of: int = 200) -> DataFrame:
    """The newest n threats among the newest `of` rows."""
    newest = audit.orderBy(F.desc("id")).limit(of)
    threats = newest.filter((F.col("action") != "allow") & F.col("checkpoint").isNotNull() & (F.col("check") != TURN_SUMMARY))
    return threats.orderBy(F.desc("id")).limit(n)


def backlog(audit: DataFrame, now: str, after_id: int | None = None, n: int = 300, minutes: int = 15) -> DataFrame:
    """Rows after an id, or the last n rows of the last minutes."""
    if after_id is not None:
        return audit.filter(F.col("id") > after_id)
    at = F.try_to_timestamp(F.lit(now))
    return audit.filter((F.col("ts_utc") >= at - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("ts_utc") <= at)).orderBy(F.desc("id")).limit(n)


def threat_bins(timeline: DataFrame, start: str, end: str, bins: int = 12) -> DataFrame:
    """Minutes of the timeline gathered in equal slices of a window: bin, requests, blocked, redacted, flagged."""
    lo, hi = (F.unix_timestamp(F.try_to_timestamp(F.lit(x))) for x in (start, end))
    t = F.unix_timestamp(F.try_to_timestamp(F.col("minute")))
    rows = timeline.filter((t >= lo) & (t < hi)).withColumn("bin", F.floor((t - lo) / (hi - lo) * bins))
    return rows.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("requests", "blocked", "redacted", "flagged")])


def guardrail_traces(audit: DataFrame) -> DataFrame:
    """Name, level, risk score and tags of every check row of a request; tags are those of the whole request."""
    rows = audit.filter("request_id IS NOT NULL")
    tag = F.array(F.col("action"), F.when(F.col("is_block"), F.concat(F.lit("blocked_by:"), "check")), F.when(F.col("is_system_event"), "system_event"))
    tags = rows.select("request_id", F.explode(tag).alias("tag")).filter("tag IS NOT NULL").groupBy("request_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    level = F.when(F.col("is_block"), "ERROR").when(F.col("action").isin("redact", "flag"), "WARNING").when(F.col("action") == "allow", "DEFAULT").otherwise("DEBUG")
    judged = F.col("decided_by").isin(JUDGE, "fallback")
    named = rows.select("request_id", "id", F.concat_ws("/", "checkpoint", "check").alias("name"), level.alias("level"), F.when(judged, F.col("score")).alias("risk"), F.when(F.col("is_block"), F.col("check")).alias("blocked_by"))
    return named.join(tags, "request_id")


