"""Usage budgets of callers: effective limits, usage at each request, checks, quotas and what-if replays."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMITS = ("requests_per_minute", "tokens_per_day", "cost_per_day")


def effective_budget(caller_roles: DataFrame, role_budgets: DataFrame) -> DataFrame:
    """The most generous of a caller's roles, limit by limit; null: unlimited; has_budget false: no budgeted role."""
    joined = caller_roles.join(F.broadcast(role_budgets.withColumn("known", F.lit(True))), "role", "left")
    best = lambda c: F.when(F.count_if(F.col("known") & F.col(c).isNull()) == 0, F.max(c)).alias(c)
    return joined.groupBy("caller_id").agg((F.count("known") > 0).alias("has_budget"), *[best(c) for c in LIMITS])


def usage_so_far(events: DataFrame, bucket_minutes: int = 60) -> DataFrame:
    """events(caller_id, id, ts_utc, forwarded, tokens, cost) with what each caller had used before each of them.

    requests_last_minute counts forwarded requests less than 60 s older; tokens_today and cost_today sum the earlier rows of the UTC day.
    The minute window is kept within (caller, hour): the last 60 s of an hour are copied into the next one, so a busy caller
    is split by time. Day sums add the totals of earlier hours to a running sum within the hour.
    """
    us = F.unix_micros("ts_utc")
    size = bucket_minutes * 60_000_000
    rows = events.withColumn("us", us).withColumn("bucket", F.floor(us / size)).withColumn("own", F.lit(True)).withColumn("day", F.to_date("ts_utc"))
    late = rows.filter(F.col("us") % size > size - 60_000_000).withColumn("bucket", F.col("bucket") + 1).withColumn("own", F.lit(False))
    minute = Window.partitionBy("caller_id", "bucket").orderBy("us").rangeBetween(-59_999_999, 0)
    before = Window.partitionBy("caller_id", "day", "bucket").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.unionByName(late).withColumn("in_minute", F.count_if("forwarded").over(minute)).filter("own")
    hours = rows.groupBy("caller_id", "day", "bucket").agg(F.sum("tokens").alias("t"), F.sum("cost").alias("c"))
    earlier = Window.partitionBy("caller_id", "day").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("caller_id", "day", "bucket", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"), F.coalesce(F.sum("c").over(earlier), F.lit(0.0)).alias("c0"))
    own = F.when(F.col("forwarded"), 1).otherwise(0)
    out = counted.withColumn("t", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("c", F.coalesce(F.sum("cost").over(before), F.lit(0.0))).join(hours, ["caller_id", "day", "bucket"])
    return out.select(*events.columns, (F.col("in_minute") - own).alias("requests_last_minute"), (F.col("t0") + F.col("t")).alias("tokens_today"), (F.col("c0") + F.col("c")).alias("cost_today"))


def check_budget(used: DataFrame, budgets: DataFrame) -> DataFrame:
    """used with verdict and reason, which lists every limit that is reached."""
    joined = used.join(budgets, "caller_id", "left")
    pairs = (("requests_last_minute", LIMITS[0]), ("tokens_today", LIMITS[1]), ("cost_today", LIMITS[2]))
    reached = [F.when(F.col(u) >= F.col(limit), F.lit(limit)) for u, limit in pairs]
    reason = F.when(~F.coalesce("has_budget", F.lit(False)), "no budgeted role").otherwise(F.concat_ws("; ", *reached))
    return joined.withColumn("reason", reason).withColumn("verdict", F.when(F.col("reason") == "", "allow").otherwise("block")).drop("has_budget", *LIMITS)


#: Seconds that a request counts for.
MINUTE = 60.0


def segments(events: DataFrame, budgets: DataFrame) -> DataFrame:
    """events with their budget, sec, day and segment: the parts of a caller's history that can be replayed apart.

    A day's first request starts a segment if the requests before it are a minute old by then, or aren't limited by minute: nothing before it
    counts any more. Found from the first and last request of each caller's days, so that no window spans a caller's rows.
    """
    joined = events.join(budgets, "caller_id").withColumn("sec", F.unix_micros("ts_utc") / 1e6).withColumn("day", F.to_date("ts_utc").cast("string"))
    days = joined.groupBy("caller_id", "day").agg(F.min("sec").alias("first"), F.max("sec").alias("last"), F.first("requests_per_minute").isNull().alias("free"))
    in_order = Window.partitionBy("caller_id").orderBy("day")
    starts = F.col("free") | F.coalesce(F.col("first") - F.lag("last").over(in_order) >= MINUTE, F.lit(True))
    numbered = days.select("caller_id", "day", starts.cast("int").alias("starts")).select("caller_id", "day", F.sum("starts").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("segment"))
    return joined.join(numbered, ["caller_id", "day"])


def replay(events: DataFrame, budgets: DataFrame) -> DataFrame:
    """What would have happened under other limits: a blocked request counts for nothing later.

    Each row is a request with its later usage. Every decision depends on those before it in its segment, whose rows stream through one task in order;
    the state is the last minute's requests and the day's sums.
    """

    def fold(batches):
        segment, day, tokens, cost, recent = None, None, 0, 0.0, deque()
        for rows in batches:
            verdicts = []
            for r in rows.itertuples():
                if (r.caller_id, r.segment) != segment:
                    segment, day, recent = (r.caller_id, r.segment), None, deque()
                if r.day != day:
                    day, tokens, cost = r.day, 0, 0.0
                while recent and recent[0] <= r.sec - MINUTE:
                    recent.popleft()
                limits = ((len(recent), r.requests_per_minute), (tokens, r.tokens_per_day), (cost, r.cost_per_day))
                block = not r.has_budget or any(not pd.isna(limit) and value >= limit for value, limit in limits)
                verdicts.append("block" if block else "allow")
                if not block:
                    recent.append(r.sec)
                    tokens, cost = tokens + r.tokens, cost + r.cost
            yield pd.DataFrame({"caller_id": rows.caller_id, "id": rows.id, "verdict": verdicts})

    rows = segments(events, budgets).select("caller_id", "segment", "id", "sec", "day", "tokens", "cost", "has_budget", *LIMITS)
    return rows.repartition("caller_id", "segment").sortWithinPartitions("caller_id", "segment", "sec", "id").mapInPandas(fold, "caller_id string, id long, verdict string")


def quotas(calls: DataFrame, per_minute: int, lifetime: int) -> DataFrame:
    """calls(key, id, ts_utc) with allowed: the first per_minute of each minute, until lifetime of them have been allowed.

    The lifetime total is a running sum of per-minute counts, so no window spans a key's whole history row by row.
    """
    rows = calls.withColumn("minute", F.floor(F.unix_timestamp("ts_utc") / 60))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("key", "minute").orderBy("ts_utc", "id")))
    minutes = rows.groupBy("key", "minute").agg(F.least(F.count("*"), F.lit(per_minute)).alias("taken"))
    before = F.sum("taken").over(Window.partitionBy("key").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1))
    totals = minutes.select("key", "minute", F.coalesce(before, F.lit(0)).alias("before"))
    joined = ranked.join(totals, ["key", "minute"])
    return joined.select(*calls.columns, ((F.col("n") <= per_minute) & (F.col("before") + F.col("n") <= lifetime)).alias("allowed"))
