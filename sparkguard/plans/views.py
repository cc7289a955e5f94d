"""The library's input tables, derived from the given parquet tables by column expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType

from ..schemas import CHECKS
from ..sources.audit import derive

#: Policy tables; their size is fixed by the policy, not by the data.
ROLE_PERMISSIONS = [("support", "customers.read"), ("developer", "customers.read"), ("developer", "files.read"), ("developer", "web.read"), ("developer", "shell.exec"), ("analyst", "docs.read")]
PERMISSION_TOOLS = [("customers.read", "query_customers"), ("files.read", "read_file"), ("web.read", "http_get"), ("shell.exec", "run_shell"), ("docs.read", "search_documents")]
ROLE_BUDGETS = [("developer", 60, 2000, 1.0), ("support", 30, 900, 0.5), ("analyst", None, 600, 0.25)]
PRICES = [("gpt-4o-mini", 0.0006), ("gemma4", 0.0)]
TOOLS = ["query_customers", "run_shell", "read_file", "http_get", "search_documents", "drop_tables"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floats rounded, as sums depend on their order; dates as text."""
    kinds = {f.name: f.dataType for f in df.schema}
    cell = {n: F.round(n, digits).alias(n) if isinstance(t, (DoubleType, FloatType)) else F.date_format(n, "yyyy-MM-dd").alias(n) if isinstance(t, DateType) else F.col(n) for n, t in kinds.items()}
    return df.select(*cell.values())


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows made of events: one to three rows a caller and day, with every checkpoint, check and action."""
    return audit_of(read(spark, sf_dir, "events"))


def audit_of(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    kind = F.col("event_type")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    day = F.date_format("ts", "yyyy-MM-dd")
    checkpoint = F.when(kind == "view", "input").when(kind == "signup", "tool_result").when(kind == "click", "tool_call").when(kind == "purchase", "output")
    check = F.when(checkpoint.isNull(), F.when(e % 2 == 0, "upstream_unavailable").otherwise("auth_failed")).when(e % 3 == 0, "turn_summary").otherwise(F.element_at(F.array(*map(F.lit, CHECKS)), (e % 7 + 1).cast("int")))
    action = F.when(F.col("value") >= 120, "block").when(F.col("value") >= 80, "redact").when(F.col("value") >= 60, "flag").otherwise("allow")
    topic = F.element_at(F.array(*map(F.lit, ("prompt_injection", "exfiltration", "code_execution"))), (e % 3 + 1).cast("int"))
    reply = kind.isin("click", "purchase")
    model = F.when(e % 2 == 0, "gpt-4o-mini").otherwise("gemma4")
    rows = events.select(
        e.alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"),
        F.when(e % 97 != 0, F.concat(F.lit("u"), "user_id", F.lit("-"), day)).alias("request_id"),
        F.when(e % 89 != 0, F.concat(F.lit("u"), "user_id")).alias("caller_id"),
        model.alias("model"),
        checkpoint.alias("checkpoint"),
        check.alias("check"),
        action.alias("action"),
        F.when(check == "signatures", F.concat(F.lit("signature SIG-"), (e % 5).cast("string"), F.lit(" ("), topic, F.lit("): matched"))).when(check == "jev", F.concat(F.lit("risk ["), topic, F.lit(", other]"))).otherwise("ok").alias("reason"),
        (F.col("value") / 250).alias("score"),
        F.col("value").alias("latency_ms"),
        F.when(check == "jev", F.when(e % 5 == 0, "fallback").otherwise("jev")).otherwise("rules").alias("decided_by"),
        F.when(reply, k).otherwise(0).alias("tokens"),
        F.when(reply & (e % 2 == 0), k / 1000 * 0.0006).otherwise(0.0).alias("cost"),
        F.concat(F.lit("0."), (e % 2 + 1).cast("string")).alias("policy_version"),
        F.col("user_id"),
        F.col("value"),
        day.alias("day"),
    )
    summary = F.col("check") == "turn_summary"
    reply = F.col("checkpoint").isin("tool_call", "output")
    calls = F.when(summary & (F.col("checkpoint") == "tool_call"), F.col("user_id") % 4)
    facts = {
        "conversation_id": F.when(summary & (F.col("id") % 11 != 0), F.concat(F.lit("s"), "user_id", F.lit("-"), (F.dayofmonth(F.to_date("day")) % 7).cast("string"))),
        "step": F.when(summary, F.col("id") % 5),
        "messages": F.when(summary, F.col("id") % 9 + 1),
        "tool_calls": calls,
        "tools": F.when(calls == 1, "run_shell").when(calls == 2, "query_customers,run_shell").when(calls == 3, "query_customers,run_shell,read_file"),
        "prompt_tokens": F.when(summary & reply, F.floor(F.col("tokens") * 3 / 4)),
        "completion_tokens": F.when(summary & reply, F.col("tokens") - F.floor(F.col("tokens") * 3 / 4)),
        "upstream_latency_ms": F.when(summary & reply & (F.col("id") % 4 != 1), F.col("value") * 10),
        "overhead_ms": F.when(summary, F.col("value") / 10),
    }
    return derive(rows.withColumns(facts).drop("user_id", "value", "day"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, message_index, role, content; every third assistant turn is a tool result."""
    c = read(spark, sf_dir, "conversations")
    role = F.when((F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 3 == 0), "tool").otherwise(F.col("role"))
    return c.select(F.concat(F.lit("c"), "conv_id").alias("request_id"), F.col("turn").alias("message_index"), role.alias("role"), F.col("text").alias("content"))


def offered_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, tools of the conversations: none to three."""
    k = F.col("conv_id")
    tools = F.slice(F.array(*map(F.lit, TOOLS)), F.lit(1), (k % 4).cast("int"))
    return read(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.concat(F.lit("c"), k).alias("request_id"), tools.alias("tools"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls of requests: request_id, caller_id, position, name, arguments (JSON), one per event."""
    e = F.col("event_id")
    name = F.element_at(F.array(*map(F.lit, TOOLS)), (e % len(TOOLS) + 1).cast("int"))
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id", F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("request_id"),
        F.concat(F.lit("u"), "user_id").alias("caller_id"),
        e.alias("position"),
        name.alias("name"),
        F.concat(F.lit('{"q": "'), F.col("event_type"), F.lit('", "n": '), (e % 4).cast("string"), F.lit("}")).alias("arguments"),
    )


def caller_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller_id, role: one or two roles per user of the events; one user in five has none that exists."""
    u = F.col("user_id")
    first = F.when(u % 5 == 0, "nobody").when(u % 3 == 0, "developer").otherwise("support")
    roles = F.when(u % 7 == 0, F.array(first, F.lit("analyst"))).otherwise(F.array(first))
    return read(spark, sf_dir, "events").select("user_id").distinct().select(F.concat(F.lit("u"), u).alias("caller_id"), F.explode(roles).alias("role"))


def policy_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "role_permissions": spark.createDataFrame(ROLE_PERMISSIONS, "role string, permission string"),
        "permission_tools": spark.createDataFrame(PERMISSION_TOOLS, "permission string, tool string"),
        "role_budgets": spark.createDataFrame(ROLE_BUDGETS, "role string, requests_per_minute long, tokens_per_day long, cost_per_day double"),
        "prices": spark.createDataFrame(PRICES, "model string, price_per_1k double"),
    }


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as payments of their customers, in integer minor units."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_custkey").alias("client_id"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_minor"),
        F.element_at(F.array(*map(F.lit, ("PLN", "EUR", "USD"))), (F.col("o_custkey") % 3 + 1).cast("int")).alias("currency"),
        F.when(F.col("o_orderkey") % 2 == 0, "credit").otherwise("debit").alias("direction"),
        F.when(F.col("o_orderstatus") == "F", "settled").when(F.col("o_orderstatus") == "O", "pending").otherwise("held").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("booked_at"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("account_id"), F.col("c_custkey").alias("client_id"), F.element_at(F.array(*map(F.lit, ("PLN", "EUR", "USD"))), (F.col("c_custkey") % 3 + 1).cast("int")).alias("currency"), F.round(F.col("c_acctbal") * 100).cast("long").alias("opening_balance_minor"))
