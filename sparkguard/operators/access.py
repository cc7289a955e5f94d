"""Role-based access to tools and models, and tool loops."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import columns as C


def allowed_tools(caller_roles: DataFrame, role_permissions: DataFrame, permission_tools: DataFrame) -> DataFrame:
    """caller_id, tool: what a caller's roles grant; unknown roles and permissions grant nothing. Policy tables are small."""
    grants = caller_roles.join(F.broadcast(role_permissions), "role").join(F.broadcast(permission_tools), "permission")
    return grants.select("caller_id", "tool").distinct()


def split_calls(calls: DataFrame, grants: DataFrame) -> DataFrame:
    """calls with allowed: whether the caller may use the named tool."""
    known = grants.select("caller_id", F.col("tool").alias("name"), F.lit(True).alias("granted"))
    return calls.join(known, ["caller_id", "name"], "left").withColumn("allowed", F.coalesce("granted", F.lit(False))).drop("granted")


def filter_tools(offers: DataFrame, grants: DataFrame) -> DataFrame:
    """Per request the offered tools in order, split into kept and removed."""
    rows = split_calls(offers, grants)
    side = lambda ok: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("allowed") == ok, F.struct("position", "name")))), lambda x: x["name"]), ",")
    return rows.groupBy("request_id").agg(side(True).alias("kept"), side(False).alias("removed"))


def deny_calls(calls: DataFrame, grants: DataFrame) -> DataFrame:
    """Per request with a denied call: the calls left, and a notice that names each denied tool once, in order."""
    rows = split_calls(calls, grants)
    first = rows.filter("NOT allowed").groupBy("request_id", "name").agg(F.min("position").alias("position"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", C.safe_label("name").alias("name")))), lambda x: x["name"]), ", ")
    notice = first.groupBy("request_id").agg(F.concat(F.lit("Tools not allowed: "), names).alias("notice"))
    left = rows.groupBy("request_id").agg(F.count_if("allowed").alias("calls_left"), F.count_if(~F.col("allowed")).alias("calls_denied"))
    return left.join(notice, "request_id")


def decision_rows(calls: DataFrame, grants: DataFrame) -> DataFrame:
    """One audit row per tool decision."""
    rows = split_calls(calls, grants)
    reason = F.concat(F.lit("tool "), C.safe_label("name"), F.when(F.col("allowed"), " allowed").otherwise(" denied"))
    return rows.select("request_id", "caller_id", "position", F.lit("rbac").alias("check"), F.when(F.col("allowed"), "allow").otherwise("block").alias("action"), reason.alias("reason"))


def check_permissions(requests: DataFrame, calls: DataFrame, grants: DataFrame, models: list[str]) -> DataFrame:
    """requests(request_id, checkpoint, model) with verdict and reason.

    The model must be listed at input and tool_result, all called tools allowed at tool_call; a tool_call without calls is an error.
    """
    denied = split_calls(calls, grants).groupBy("request_id").agg(
        F.count("*").alias("n_calls"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("allowed"), C.safe_label("name")))), ", ").alias("denied")
    )
    joined = requests.join(denied, "request_id", "left")
    at_call, at_request = F.col("checkpoint") == "tool_call", F.col("checkpoint").isin("input", "tool_result")
    no_calls, some = F.coalesce("n_calls", F.lit(0)) == 0, F.coalesce("denied", F.lit("")) != ""
    listed = F.coalesce(F.col("model").isin(*models), F.lit(False))
    verdict = F.when(at_call & no_calls, "error").when((at_call & some) | (at_request & ~listed), "block").otherwise("allow")
    reason = F.when(at_call & no_calls, "no tool calls").when(at_call & some, F.concat(F.lit("tools not allowed: "), "denied")).when(at_request & ~listed, F.concat(F.lit("model not allowed: "), C.safe_label("model"))).otherwise("")
    return joined.select(*requests.columns, verdict.alias("verdict"), reason.alias("reason"))


def _tidy(node):
    """White space of string values collapsed, keys sorted; numbers stay as they are written."""
    if isinstance(node, str):
        return " ".join(node.split())
    if isinstance(node, dict):
        return {k: _tidy(v) for k, v in node.items()}
    return [_tidy(v) for v in node] if isinstance(node, list) else node


@F.pandas_udf(StringType())
def canonical_args(arguments: pd.Series) -> pd.Series:
    """One text for arguments that differ in key order or white space only; text that isn't JSON stands for itself."""

    def one(text):
        try:
            return json.dumps(_tidy(json.loads(text)), sort_keys=True)
        except (TypeError, ValueError, RecursionError):
            return text

    return arguments.map(one)


def check_loops(calls: DataFrame, max_calls: int | None, max_repeats: int | None, messages: DataFrame | None = None) -> DataFrame:
    """Per request: calls, most repeated call, verdict; calls before the last user message don't count if messages are given.

    Arguments are hashed before the shuffle, so long ones don't travel.
    """
    if messages is not None:
        start = messages.groupBy("request_id").agg(F.max(F.when(F.col("role") == "user", F.col("message_index"))).alias("start"))
        calls = calls.join(start, "request_id", "left").filter("start IS NULL OR message_index > start")
    same = calls.groupBy("request_id", "name", F.xxhash64(canonical_args("arguments")).alias("args")).agg(F.count("*").alias("n"), F.min("position").alias("first"))
    found = same.groupBy("request_id").agg(F.sum("n").alias("calls"), F.max("n").alias("repeats"), F.min_by("name", F.struct(-F.col("n"), "first")).alias("most"))
    many = F.col("calls") > max_calls if max_calls is not None else F.lit(False)
    again = F.col("repeats") > max_repeats if max_repeats is not None else F.lit(False)
    reason = F.when(many, F.concat(F.lit("too many tool calls: "), F.col("calls").cast("string"))).when(again, F.concat(C.safe_label("most"), F.lit(" repeated "), F.col("repeats").cast("string"), F.lit(" times"))).otherwise("")
    return found.select("request_id", "calls", "repeats", F.when(many | again, "block").otherwise("allow").alias("verdict"), reason.alias("reason"))


def step_numbers(messages: DataFrame) -> DataFrame:
    """messages with the number of assistant messages before each of them."""
    w = Window.partitionBy("request_id").orderBy("message_index").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("step", F.count_if(F.col("role") == "assistant").over(w))
