"""Chat logs: bodies to tables, checkpoints, sessions, scan targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

_CALL = "STRUCT<id: STRING, type: STRING, function: STRUCT<name: STRING, arguments: STRING>>"
_MESSAGE = f"STRUCT<role: STRING, content: STRING, tool_calls: ARRAY<{_CALL}>, tool_call_id: STRING>"
_TOOL = "STRUCT<type: STRING, function: STRUCT<name: STRING, description: STRING>>"
_BODY = f"model STRING, messages ARRAY<{_MESSAGE}>, tools ARRAY<{_TOOL}>"
_PART = "ARRAY<STRUCT<type: STRING, text: STRING>>"
_REPLY = f"choices ARRAY<STRUCT<message: {_MESSAGE}, finish_reason: STRING>>, usage STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT>"
ROLES = ("system", "user", "assistant", "tool")


def _text(content: Column) -> Column:
    """Content as text: text parts of a list are joined, other parts dropped."""
    parts = F.from_json(content, _PART)
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p.type == "text"), lambda p: F.coalesce(p.text, F.lit(""))), "")
    return F.when(F.ltrim(content).startswith("[") & parts.isNotNull(), joined).otherwise(content)


def _object(arguments: Column) -> Column:
    """Arguments as the text of a JSON object; empty counts as {}; null: not an object.

    Spark's JSON parsers stop at the end of a value. As an element of a list, and as a field of an object, text after the value is an error
    in one of both.
    """
    plain = F.when(F.trim(F.coalesce(arguments, F.lit(""))) == "", "{}").otherwise(arguments)
    inside = lambda before, after: F.try_parse_json(F.concat(F.lit(before), plain, F.lit(after))).isNotNull()
    return F.when(F.ltrim(plain).startswith("{") & inside("[", "]") & inside('{"a":', "}"), plain)


def normalize_chat(bodies: DataFrame) -> dict[str, DataFrame]:
    """bodies(request_id, caller_id, body JSON) to requests, messages, calls and bad (quarantined) tables."""
    parsed = bodies.withColumn("b", F.from_json("body", _BODY))
    role = lambda m: F.when(m.role == "developer", "system").otherwise(m.role)
    messages = F.transform("b.messages", lambda m: F.struct(role(m).alias("role"), _text(m.content).alias("content"), m.tool_calls.alias("tool_calls"), m.tool_call_id.alias("tool_call_id")))
    rows = parsed.withColumn("messages", messages)
    fine_roles = F.forall("messages", lambda m: F.coalesce(m.role.isin(*ROLES), F.lit(False)))
    fine_calls = F.forall("messages", lambda m: F.forall(F.coalesce(m.tool_calls, F.array().cast(f"ARRAY<{_CALL}>")), lambda c: _object(c.function.arguments).isNotNull() & c.function["name"].isNotNull()))
    reason = (
        F.when(F.col("b").isNull() | F.col("b.messages").isNull() | F.col("b.model").isNull(), "not a chat request")
        .when(F.size("messages") == 0, "no messages")
        .when(~fine_roles, "unknown role")
        .when(~fine_calls, "tool arguments are not an object")
    )
    rows = rows.withColumn("bad_request", reason)
    good = rows.filter("bad_request IS NULL")
    each = good.select("request_id", "caller_id", F.posexplode("messages").alias("message_index", "m"))
    calls = each.select("request_id", "caller_id", "message_index", F.posexplode("m.tool_calls").alias("position", "c"))
    return {
        "requests": good.select("request_id", "caller_id", "b.model", F.transform("b.tools", lambda t: t.function["name"]).alias("tools"), F.size("messages").alias("n_messages")),
        "messages": each.select("request_id", "message_index", "m.role", "m.content", "m.tool_call_id"),
        "calls": calls.select("request_id", "caller_id", "message_index", "position", "c.id", F.col("c.function.name").alias("name"), _object(F.col("c.function.arguments")).alias("arguments")),
        "bad": rows.filter("bad_request IS NOT NULL").select("request_id", "caller_id", "body", "bad_request"),
    }


def normalize_replies(replies: DataFrame) -> DataFrame:
    """replies(request_id, body JSON) to the first choice as an assistant message with its usage; missing counts are 0."""
    r = replies.withColumn("r", F.from_json("body", _REPLY))
    m = F.get("r.choices", F.lit(0)).message
    zero = lambda c: F.coalesce(c, F.lit(0))
    return r.select("request_id", F.lit("assistant").alias("role"), _text(m.content).alias("content"), m.tool_calls.alias("tool_calls"), zero("r.usage.prompt_tokens").alias("prompt_tokens"), zero("r.usage.completion_tokens").alias("completion_tokens"))


def sessions(messages: DataFrame, callers: DataFrame) -> DataFrame:
    """request_id, conversation_id: from the caller and the request's first user message."""
    first = messages.groupBy("request_id").agg(F.min_by(F.when(F.col("role") == "user", F.struct("content")), F.when(F.col("role") == "user", F.col("message_index"))).alias("f"))
    return callers.join(first, "request_id", "left").select("request_id", C.conversation_id("caller_id", "f.content").alias("conversation_id"))


def request_checkpoints(messages: DataFrame) -> DataFrame:
    """tool_result where the last message is a tool's, else input."""
    last = messages.groupBy("request_id").agg(F.max_by("role", "message_index").alias("last"), F.count("*").alias("messages"))
    return last.select("request_id", F.when(F.col("last") == "tool", "tool_result").otherwise("input").alias("checkpoint"), "messages")


def reply_checkpoints(replies: DataFrame) -> DataFrame:
    return replies.withColumn("checkpoint", F.when(F.size(F.coalesce("tool_calls", F.array().cast(f"ARRAY<{_CALL}>"))) > 0, "tool_call").otherwise("output"))


def scan_targets(messages: DataFrame, scope: str = "all", skip_roles: tuple[str, ...] = ()) -> DataFrame:
    """Messages that a check reads: every non-empty one, or (scope new) the trailing tool messages, else the last user message."""
    rows = messages
    if scope == "new":
        marks = messages.groupBy("request_id").agg(
            F.max(F.when(F.col("role") != "tool", F.col("message_index"))).alias("last_other"),
            F.max(F.when(F.col("role") == "user", F.col("message_index"))).alias("last_user"),
            F.max("message_index").alias("last"),
        )
        trailing = F.col("last") > F.coalesce("last_other", F.lit(-1))
        wanted = F.when(trailing, F.col("message_index") > F.coalesce("last_other", F.lit(-1))).otherwise(F.col("message_index") == F.col("last_user"))
        rows = messages.join(marks, "request_id").filter(wanted).select(*messages.columns)
    rows = rows.filter("content IS NOT NULL AND content <> ''")
    return rows.filter(~F.col("role").isin(*skip_roles)) if skip_roles else rows


def call_views(messages: DataFrame, calls: DataFrame, reasoning: DataFrame | None = None) -> DataFrame:
    """request_id, view: the text about a reply's tool calls that later checks read; missing parts are (none)."""
    task = messages.filter("role = 'user' AND content <> ''").groupBy("request_id").agg(F.max_by("content", "message_index").alias("task"))
    listed = calls.groupBy("request_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("position", "name", "arguments"))), lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")))).alias("listed"))
    rows = listed.join(task, "request_id", "left")
    rows = rows.join(reasoning, "request_id", "left") if reasoning is not None else rows.withColumn("reasoning", F.lit(None).cast("string"))
    none = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(none)"))
    return rows.select("request_id", F.concat_ws("\n", F.concat(F.lit("task: "), none("task")), F.concat(F.lit("agent reasoning: "), none("reasoning")), F.concat(F.lit("tool calls: "), "listed")).alias("view"))
