"""Turns (one request's summary rows), sessions, agents and economics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import TURN_SUMMARY
from .metrics import overhead, percentiles, totals, usage_total


def summary_rows(audit: DataFrame) -> DataFrame:
    return audit.filter(F.col("check") == TURN_SUMMARY)


def turns(audit: DataFrame) -> DataFrame:
    """One row per request: caller and session of its first request row (else of its first row), outcome, sums, stages.

    upstream_ms is null if the model was never reached, post_ms if there is no reply row.
    """
    rows = summary_rows(audit).filter("request_id IS NOT NULL")
    first = F.struct((~C.at_request()).alias("late"), "id")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    names = F.filter(F.flatten(F.collect_list(F.split("tools", ","))), lambda x: x != "")
    return (
        rows.groupBy("request_id")
        .agg(
            F.min_by(F.struct("caller_id", "conversation_id"), first).alias("who"),
            F.max(C.strength()).alias("strength"),
            F.sum(F.coalesce("tool_calls", F.lit(0))).alias("tool_calls"),
            F.array_sort(names).alias("tools"),
            F.sum("tokens").alias("tokens"),
            F.sum("cost").alias("cost"),
            F.sum("upstream_latency_ms").alias("upstream_ms"),
            F.sum(zero(F.col("overhead_ms"))).alias("overhead_ms"),
            F.sum(F.when(C.at_request(), zero(F.col("overhead_ms"))).otherwise(0.0)).alias("pre_ms"),
            F.sum(F.when(~C.at_request(), zero(F.col("overhead_ms")))).alias("post_ms"),
        )
        .select("request_id", "who.*", C.action_of("strength").alias("action"), "tool_calls", "tools", "tokens", "cost", "upstream_ms", "overhead_ms", "pre_ms", "post_ms")
    )


def request_latency(turn: DataFrame) -> DataFrame:
    total = turn.withColumn("total_ms", F.col("pre_ms") + F.coalesce("upstream_ms", F.lit(0.0)) + F.coalesce("post_ms", F.lit(0.0)))
    found = percentiles(total, {v: v for v in ("pre_ms", "upstream_ms", "post_ms", "total_ms")})
    return found.withColumns({f"ttft_ms_p{p}": F.col(f"total_ms_p{p}") for p in (50, 95)})


def agents(turn: DataFrame) -> DataFrame:
    """Per caller: sessions, steps, outcomes, usage and latency; grouped by session first, so a busy caller is no hot key."""
    rows = turn.filter("caller_id IS NOT NULL")
    reached = F.col("upstream_ms").isNotNull()
    sums = {
        "turns": F.count("*"),
        "tool_calls": F.sum("tool_calls"),
        "blocked_turns": F.count_if(F.col("action") == "block"),
        "redacted_turns": F.count_if(F.col("action") == "redact"),
        "flagged_turns": F.count_if(F.col("action") == "flag"),
        "tokens": F.sum("tokens"),
        "cost": F.sum("cost"),
        "reached": F.count_if(reached),
        "upstream": F.sum(F.coalesce("upstream_ms", F.lit(0.0))),
        "reached_overhead": F.sum(F.when(reached, F.col("overhead_ms")).otherwise(0.0)),
        "overhead": F.sum("overhead_ms"),
    }
    per_session = rows.groupBy("caller_id", "conversation_id").agg(*[v.alias(k) for k, v in sums.items()])
    in_session = F.when(F.col("conversation_id").isNotNull(), F.col("turns"))
    per_caller = per_session.groupBy("caller_id").agg(
        F.count("conversation_id").alias("sessions"),
        F.coalesce(F.sum(in_session), F.lit(0)).alias("steps"),
        F.coalesce(F.max(in_session), F.lit(0)).alias("max_steps"),
        *[F.sum(k).alias(k) for k in sums],
    )
    c = F.col
    return per_caller.select(
        "caller_id",
        "sessions",
        "turns",
        C.ratio(c("steps"), c("sessions")).alias("avg_steps_per_session"),
        "max_steps",
        "tool_calls",
        "blocked_turns",
        C.ratio(c("blocked_turns"), c("turns")).alias("block_rate"),
        "redacted_turns",
        "flagged_turns",
        "tokens",
        "cost",
        C.ratio(c("upstream"), c("reached")).alias("avg_upstream_latency_ms"),
        C.ratio(c("overhead"), c("turns")).alias("avg_overhead_ms"),
        C.ratio(c("reached_overhead"), c("reached_overhead") + c("upstream")).alias("overhead_share"),
    )


def tool_usage(turn: DataFrame) -> DataFrame:
    return turn.filter("caller_id IS NOT NULL").select("caller_id", F.explode("tools").alias("tool")).groupBy("caller_id", "tool").agg(F.count("*").alias("calls"))


def cost_by(audit: DataFrame) -> DataFrame:
    """Cost per model, caller and UTC day in one pass of grouping sets: dimension, key, cost."""
    rows = summary_rows(audit).select("model", "caller_id", F.col("date").cast("string").alias("day"), "cost")
    sets = rows.groupingSets([["model"], ["caller_id"], ["day"]], "model", "caller_id", "day")
    sums = sets.agg(F.grouping("model").alias("no_model"), F.grouping("caller_id").alias("no_caller"), F.sum("cost").alias("cost"))
    dimension = F.when(F.col("no_model") == 0, "model").when(F.col("no_caller") == 0, "caller").otherwise("day")
    return sums.select(dimension.alias("dimension"), F.coalesce("model", "caller_id", "day").alias("key"), "cost").filter("key IS NOT NULL")


def tokens_by_model(audit: DataFrame) -> DataFrame:
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return summary_rows(audit).filter("model IS NOT NULL").groupBy("model").agg(zero("prompt_tokens").alias("prompt"), zero("completion_tokens").alias("completion"), F.sum("tokens").alias("total"))


def session_cost(turn: DataFrame) -> DataFrame:
    per_session = turn.filter("conversation_id IS NOT NULL").groupBy("conversation_id").agg(F.sum("cost").alias("cost"))
    return percentiles(per_session, {"cost": "cost"}).crossJoin(per_session.agg(F.coalesce(F.avg("cost"), F.lit(0.0)).alias("cost_avg")))  # one row each


def turn_cost(turn: DataFrame) -> DataFrame:
    return turn.agg(F.coalesce(F.avg("cost"), F.lit(0.0)).alias("cost_per_turn_avg"))


def blocked_before_upstream(audit: DataFrame) -> DataFrame:
    return summary_rows(audit).agg(F.count_if((F.col("action") == "block") & C.at_request()).alias("blocked_before_upstream"))


def history_row(per_request: DataFrame, usage: DataFrame, agent: DataFrame) -> DataFrame:
    """One flat row of headline numbers; every side is a one-row aggregate."""
    sums = agent.agg(F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"))
    return totals(per_request).crossJoin(overhead(per_request)).crossJoin(usage_total(usage)).crossJoin(sums)


def measures(audit: DataFrame) -> DataFrame:
    """Per caller and day: distinct turns, distinct sessions on request rows, block rate, cost, overhead share of all turns."""
    rows = summary_rows(audit).filter("caller_id IS NOT NULL")
    return (
        rows.groupBy("caller_id", "date")
        .agg(
            F.count_distinct("request_id").alias("turns"),
            F.count_distinct(F.when(C.at_request(), F.col("conversation_id"))).alias("sessions"),
            F.count_distinct(F.when(F.col("is_block"), F.col("request_id"))).alias("blocked"),
            F.sum("cost").alias("cost"),
            F.sum(F.coalesce("overhead_ms", F.lit(0.0))).alias("overhead"),
            F.sum(F.coalesce("upstream_latency_ms", F.lit(0.0))).alias("upstream"),
        )
        .select("caller_id", "date", "turns", "sessions", C.ratio(F.col("blocked"), F.col("turns")).alias("block_rate"), "cost", C.ratio(F.col("overhead"), F.col("overhead") + F.col("upstream")).alias("overhead_share"))
    )


def request_trace(audit: DataFrame) -> DataFrame:
    """Per request and checkpoint the checks in order, the summary's reason, tokens and cost."""
    rows = audit.filter("request_id IS NOT NULL AND checkpoint IS NOT NULL")
    check = F.col("check") != TURN_SUMMARY
    return rows.groupBy("request_id", "checkpoint").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(check, F.struct("id", "check", "action")))), lambda x: F.concat_ws(":", x.check, x.action)), ",").alias("checks"),
        F.max(F.when(~check, F.col("reason"))).alias("summary"),
        F.max("tokens").alias("tokens"),
        F.max("cost").alias("cost"),
    )


def live_turns(audit: DataFrame, n: int = 60) -> DataFrame:
    """The newest n turns: stage timings and state, failed before running before the strongest action."""
    rows = audit.filter("request_id IS NOT NULL")
    summary, reply = F.col("check") == TURN_SUMMARY, ~C.at_request() & F.col("checkpoint").isNotNull()
    grouped = rows.groupBy("request_id").agg(
        F.max("id").alias("last_id"),
        F.count_if(F.col("check") == "upstream_unavailable").alias("failed"),
        F.count_if(summary & reply).alias("replies"),
        F.max(F.when(summary, C.strength())).alias("strength"),
        F.sum(F.when(summary & C.at_request(), F.col("overhead_ms"))).alias("pre_ms"),
        F.sum(F.when(summary, F.col("upstream_latency_ms"))).alias("model_ms"),
        F.sum(F.when(summary & reply, F.col("overhead_ms"))).alias("post_ms"),
    )
    done = (F.col("replies") > 0) | (F.col("strength") == 3)
    state = F.when(F.col("failed") > 0, "failed").when(~F.coalesce(done, F.lit(False)), "running").otherwise(C.action_of("strength"))
    return grouped.select("request_id", "last_id", state.alias("state"), "pre_ms", "model_ms", "post_ms").orderBy(F.desc("last_id")).limit(n)
