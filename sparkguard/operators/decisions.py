"""From check results to decisions, turn summaries and reports; inputs of an external judge."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import CHECKS


#: Place of a reply's text, after all messages.
REPLY_INDEX = 2**31 - 1


def call_texts(views: DataFrame) -> DataFrame:
    """views(request_id, view) of replies' tool calls as texts for judge_inputs."""
    return views.select("request_id", F.lit(REPLY_INDEX).alias("message_index"), F.lit("assistant").alias("role"), F.col("view").alias("content"), F.lit("tool_call").alias("captured_at"))


def judge_inputs(texts: DataFrame, max_chars: int, text: str = "content", requests: DataFrame | None = None) -> DataFrame:
    """texts(request_id, message_index, role, content) cut into slices of max_chars code points, with checkpoint and context.

    A captured_at of the texts' own (as of call_texts) goes before the role's. The context is what the judge is told beside
    the text: the role and the tools that the request offers, by requests(request_id, tools); none without it. Inputs are
    the same if checkpoint, context and text are.
    """
    at = F.when(F.col("role") == "tool", "tool_result").when(F.col("role") == "assistant", "output").otherwise("input")
    rows = texts.filter(F.length(text) > 0).withColumn("captured_at", F.coalesce("captured_at", at) if "captured_at" in texts.columns else at)
    tools = F.lit("none")
    if requests is not None:
        rows = rows.join(requests.select("request_id", F.array_join("tools", ", ").alias("offered")), "request_id", "left")
        tools = F.coalesce(F.nullif("offered", F.lit("")), tools)
    rows = rows.withColumn("context", F.concat(F.lit("message role: "), "role", F.lit("; offered tools: "), tools))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / max_chars).cast("int")), lambda i: F.substr(text, i * max_chars + 1, F.lit(max_chars)))
    cut = rows.select("request_id", "message_index", "captured_at", "context", F.posexplode(pieces).alias("chunk", "text"))
    return cut.withColumn("input_key", F.sha2(F.concat_ws("\u0000", "captured_at", F.sha2("context", 256), "text"), 256))


def plan_judging(inputs: DataFrame, verdicts: DataFrame, max_calls: int) -> tuple[DataFrame, DataFrame]:
    """(distinct inputs still to be judged, requests that need more than max_calls new ones and so fail)."""
    new = inputs.join(verdicts.select("input_key"), "input_key", "left_anti")
    per_request = new.select("request_id", "input_key").distinct().groupBy("request_id").agg(F.count("*").alias("new_inputs"))
    return new.dropDuplicates(["input_key"]).select("input_key", "captured_at", "context", "text"), per_request.filter(F.col("new_inputs") > max_calls)


def judge(plan: DataFrame, ask: Callable[[list[dict]], list[dict]], batch: int = 64, parallel: int | None = None) -> DataFrame:
    """Verdicts of a judge over the distinct inputs of plan_judging(): ask gets batches of captured_at, context and text, and gives score, reason and categories.

    A judge is slow, so its inputs are spread over parallel tasks whatever their files are. A score outside 0 to 1, or none, is an error.
    """
    rows = plan.select("input_key", "captured_at", "context", "text").repartition(parallel or plan.sparkSession.sparkContext.defaultParallelism)

    def work(batches):
        for frame in batches:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                answers = ask(part[["captured_at", "context", "text"]].to_dict("records"))
                if len(answers) != len(part) or not all(0 <= a["score"] <= 1 for a in answers):
                    raise ValueError("a judge gives one score from 0 to 1 for each input")
                yield pd.DataFrame({"input_key": part.input_key.to_numpy(), "score": [float(a["score"]) for a in answers], "reason": [a.get("reason", "") for a in answers], "categories": [list(a.get("categories", ())) for a in answers]})

    return rows.mapInPandas(work, "input_key string, score double, reason string, categories array<string>")


def check_judge(inputs: DataFrame, verdicts: DataFrame, threshold: float) -> DataFrame:
    """Per request the chunk with the highest score (the first on ties) decides; block from the threshold on."""
    joined = inputs.join(verdicts, "input_key")
    top = joined.groupBy("request_id").agg(F.max_by(F.struct("score", "reason", "categories"), F.struct("score", -F.col("message_index"), -F.col("chunk"))).alias("v"))
    reason = F.concat(F.col("v.reason"), F.when(F.size("v.categories") > 0, F.concat(F.lit(" ["), F.array_join("v.categories", ", "), F.lit("]"))).otherwise(""))
    return top.select("request_id", F.col("v.score").alias("score"), F.when(F.col("v.score") >= threshold, "block").otherwise("allow").alias("verdict"), reason.alias("reason"))


def decide(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results(request_id, checkpoint, check, verdict, ...) to (recorded results, decisions).

    Checks run in cost order and stop at the first block; later results aren't recorded. The strongest action decides.
    """
    rank = F.array_position(F.array(*map(F.lit, CHECKS)), F.col("check"))
    rows = results.withColumn("rank", rank).withColumn("action", C.verdict_action())
    cut = F.min(F.when(F.col("action") == "block", F.col("rank"))).over(Window.partitionBy("request_id", "checkpoint"))
    kept = rows.withColumn("cut", cut).filter("cut IS NULL OR rank <= cut")
    decisions = kept.groupBy("request_id", "checkpoint").agg(C.action_of(F.max(C.strength())).alias("action"), F.max(F.when(F.col("action") == "block", F.col("check"))).alias("blocked_by"), F.count("*").alias("checks_run"))
    return kept.drop("rank", "cut"), decisions


def turn_summary(decisions: DataFrame, kept: DataFrame, messages: DataFrame, calls: DataFrame, usage: DataFrame, prices: DataFrame) -> DataFrame:
    """One fact row per request and checkpoint: decision, scores and time of its checks, steps, tools, usage and cost."""
    from .access import step_numbers

    stats = kept.groupBy("request_id", "checkpoint").agg(F.max("score").alias("score"), F.sum("latency_ms").alias("overhead_ms"), F.max_by("decided_by", "score").alias("decided_by"))
    steps = step_numbers(messages).groupBy("request_id").agg(F.max("step").alias("step"), F.count("*").alias("messages"))
    tools = calls.groupBy("request_id").agg(F.count("*").alias("tool_calls"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", C.safe_label("name").alias("name")))), lambda x: x["name"]), ",").alias("tools"))
    paid = usage.join(F.broadcast(prices), "model", "left").withColumn("used", F.col("prompt_tokens") + F.col("completion_tokens"))
    paid = paid.select("request_id", "model", "prompt_tokens", "completion_tokens", F.col("used").alias("tokens"), C.cost_of(F.col("used"), F.col("price_per_1k")).alias("cost"))
    rows = decisions.join(stats, ["request_id", "checkpoint"], "left").join(steps, "request_id", "left").join(tools, "request_id", "left").join(paid, "request_id", "left")
    reply = ~C.at_request()
    only = lambda c: F.when(reply, F.col(c)).alias(c)
    reason = F.concat(F.col("action"), F.coalesce(F.concat(F.lit(" by "), F.col("blocked_by")), F.lit("")))
    return rows.select("request_id", "checkpoint", F.lit("turn_summary").alias("check"), "action", reason.alias("reason"), "score", "overhead_ms", "decided_by", "step", "messages", only("tool_calls"), only("tools"), only("prompt_tokens"), only("completion_tokens"), F.when(reply, F.col("tokens")).otherwise(0).alias("tokens"), F.when(reply, F.col("cost")).otherwise(0.0).alias("cost"), "model", "blocked_by")


def conformance(outcomes: DataFrame, expected: DataFrame) -> DataFrame:
    """Cases whose outcome differs from what was expected, with what differs; missing on either side counts."""
    o, e = outcomes.alias("o"), expected.alias("e")
    joined = o.join(e, F.col("o.case") == F.col("e.case"), "full_outer")
    differs = F.array_compact(
        F.array(
            F.when(F.col("o.case").isNull(), "missing outcome"),
            F.when(F.col("e.case").isNull(), "unexpected case"),
            F.when(F.col("o.action") != F.col("e.action"), "action"),
            F.when(F.col("e.blocked_by").isNotNull() & ~F.col("o.blocked_by").eqNullSafe(F.col("e.blocked_by")), "blocked_by"),
            F.when(F.col("e.reason_contains").isNotNull() & ~F.coalesce(F.contains("o.reason", "e.reason_contains"), F.lit(False)), "reason"),
        )
    )
    return joined.select(F.coalesce("o.case", "e.case").alias("case"), F.array_join(differs, ",").alias("differs")).filter("differs <> ''")


def findings(kept: DataFrame) -> DataFrame:
    """Per request the distinct check:action of blocks and redactions, sorted and joined."""
    rows = kept.filter(F.col("action").isin("block", "redact"))
    return rows.groupBy("request_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "check", "action"))), ", ").alias("findings"))
