"""Registered queries over the audit log, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import turns as T
from . import sql as S
from . import views as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of the audit rows."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return V.rounded(f(V.audit(spark, sf_dir)))

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return f

    return wrap


OUT = ("allowed", "redacted", "blocked", "flagged")
_COUNT = {"allowed": 0, "flagged": 1, "redacted": 2, "blocked": 3}

query("audit_derived_columns", S.with_audit("SELECT id, strftime(date, '%Y-%m-%d') AS date, hour, minute, is_block, is_redact, is_flag, is_system_event, category FROM audit"))(lambda a: a.select("id", "date", "hour", "minute", "is_block", "is_redact", "is_flag", "is_system_event", "category"))
query("request_totals", S.with_audit("SELECT count(*) AS requests, " + ", ".join(f"count(*) FILTER (WHERE strength = {_COUNT[n]}) AS {n}" for n in OUT) + " FROM requests", S.REQUESTS))(lambda a: M.totals(M.requests(a)))
query("timeline", S.with_audit("SELECT strftime(first_ts, '%Y-%m-%dT%H:%M:00Z') AS minute, count(*) AS requests, " + ", ".join(f"count(*) FILTER (WHERE strength = {_COUNT[n]}) AS {n}" for n in OUT[1:]) + " FROM requests GROUP BY 1", S.REQUESTS))(lambda a: M.timeline(M.requests(a)))
query("request_overhead", S.with_audit(f"SELECT * FROM ({S.percentiles('requests', 'overhead_ms', 'overhead_ms')}) CROSS JOIN ({S.percentiles('requests', 'rules_overhead_ms', 'rules_overhead_ms')})", S.REQUESTS))(lambda a: M.overhead(M.requests(a)))
for _k in ("check", "checkpoint", "caller_id"):
    query(f"blocks_by_{_k}", S.with_audit(f'SELECT "{_k}", count(*) AS blocks FROM checks WHERE is_block AND "{_k}" IS NOT NULL GROUP BY 1', S.CHECK_ROWS))(lambda a, k=_k: M.blocks_by(a, k))
query("blocks_by_all", S.with_audit(" UNION ALL ".join(f"""SELECT '{k}' AS dimension, "{k}" AS key, count(*) AS blocks FROM checks WHERE is_block AND "{k}" IS NOT NULL GROUP BY 2""" for k in ("check", "checkpoint", "caller_id")), S.CHECK_ROWS))(M.blocks_by_all)
query("actions_by_check", S.with_audit('SELECT "check", ' + ", ".join(f"count(*) FILTER (WHERE action = '{x}') AS {x}" for x in ("allow", "flag", "redact", "block")) + " FROM checks GROUP BY 1", S.CHECK_ROWS))(M.actions_by_check)
query("decided_by", S.with_audit("SELECT d AS decided_by, count(checks.id) AS rows FROM (SELECT unnest(['rules', 'jev', 'fallback']) AS d) LEFT JOIN checks ON decided_by = d GROUP BY 1", S.CHECK_ROWS))(M.decided_by)
query("latency_by_check", S.with_audit(S.percentiles("checks", "latency_ms", "latency_ms", '"check"'), S.CHECK_ROWS))(M.latency_by_check)
query("latency_by_check_ranked", ORACLES["latency_by_check"])(M.latency_by_check_ranked)
query("jev_latency", S.with_audit(S.percentiles("(SELECT * FROM checks WHERE \"check\" = 'jev')", "latency_ms", "jev_latency_ms"), S.CHECK_ROWS))(M.judge_latency)
query("system_events", S.with_audit('SELECT "check", count(*) AS rows FROM audit WHERE is_system_event GROUP BY 1'))(M.system_events)
query("top_block_reasons", S.with_audit('SELECT "check", reason, count(*) AS count FROM checks WHERE is_block GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10', S.CHECK_ROWS))(M.top_block_reasons)
query("usage_rows", S.with_audit("SELECT request_id, caller_id, strftime(date, '%Y-%m-%d') AS date, tokens, round(cost, 6) AS cost, id FROM usage", S.USAGE))(M.usage_rows)
query("usage_today", S.with_audit("SELECT caller_id, sum(tokens)::BIGINT AS tokens_today, round(sum(cost), 6) AS cost_today FROM usage WHERE date = DATE '2024-01-15' AND caller_id IS NOT NULL GROUP BY 1", S.USAGE))(lambda a: M.usage_today(M.usage_rows(a), "2024-01-15"))
query("usage_total", S.with_audit("SELECT sum(tokens)::BIGINT AS tokens_total, round(sum(cost), 6) AS cost_total FROM usage", S.USAGE))(lambda a: M.usage_total(M.usage_rows(a)))
query("policy_versions", S.with_audit("SELECT policy_version, count(*) AS rows FROM audit GROUP BY 1"))(M.policy_versions)
query("request_totals_since", S.with_audit("SELECT count(*) AS requests, " + ", ".join(f"count(*) FILTER (WHERE strength = {_COUNT[n]}) AS {n}" for n in OUT) + " FROM requests", S.REQUESTS.replace("NOT is_system_event", "NOT is_system_event AND ts_utc >= TIMESTAMP '2024-01-10 12:00:00'")))(lambda a: M.totals(M.requests(M.since(a, "2024-01-10T12:00:00Z"))))

query("turns", S.with_audit("SELECT request_id, caller_id, conversation_id, action, tool_calls::BIGINT AS tool_calls, tokens::BIGINT AS tokens, round(cost, 6) AS cost, round(upstream_ms, 6) AS upstream_ms, round(overhead_ms, 6) AS overhead_ms, round(pre_ms, 6) AS pre_ms, round(post_ms, 6) AS post_ms FROM turns", S.TURNS))(lambda a: T.turns(a).drop("tools"))
query("request_latency", S.with_audit("SELECT *, total_ms_p50 AS ttft_ms_p50, total_ms_p95 AS ttft_ms_p95 FROM (" + ") CROSS JOIN (".join(S.percentiles("t", v, v) for v in ("pre_ms", "upstream_ms", "post_ms", "total_ms")) + ")", S.TURNS + ", t AS (SELECT *, pre_ms + coalesce(upstream_ms, 0) + coalesce(post_ms, 0) AS total_ms FROM turns)"))(lambda a: T.request_latency(T.turns(a)))
_AGENTS = """SELECT t.caller_id, count(DISTINCT t.conversation_id) AS sessions, count(*) AS turns,
  round(CASE WHEN count(DISTINCT t.conversation_id) > 0 THEN CAST(count(t.conversation_id) AS DOUBLE) / count(DISTINCT t.conversation_id) ELSE 0 END, 6) AS avg_steps_per_session,
  coalesce(max(s.n), 0) AS max_steps, sum(tool_calls)::BIGINT AS tool_calls, count(*) FILTER (WHERE action = 'block') AS blocked_turns, round(avg(CASE WHEN action = 'block' THEN 1.0 ELSE 0.0 END), 6) AS block_rate,
  count(*) FILTER (WHERE action = 'redact') AS redacted_turns, count(*) FILTER (WHERE action = 'flag') AS flagged_turns, sum(tokens)::BIGINT AS tokens, round(sum(cost), 6) AS cost,
  round(coalesce(avg(upstream_ms), 0), 6) AS avg_upstream_latency_ms, round(avg(overhead_ms) + 1e-9, 6) AS avg_overhead_ms,
  round(coalesce(sum(CASE WHEN upstream_ms IS NOT NULL THEN overhead_ms END) / nullif(sum(CASE WHEN upstream_ms IS NOT NULL THEN overhead_ms + upstream_ms END), 0), 0), 6) AS overhead_share
  FROM turns t LEFT JOIN s ON s.caller_id = t.caller_id AND s.conversation_id = t.conversation_id WHERE t.caller_id IS NOT NULL GROUP BY 1"""
query("agents", S.with_audit(_AGENTS, S.TURNS + ", s AS (SELECT caller_id, conversation_id, count(*) AS n FROM turns WHERE conversation_id IS NOT NULL GROUP BY 1, 2)"))(lambda a: T.agents(T.turns(a)).withColumn("avg_overhead_ms", F.col("avg_overhead_ms") + 1e-9))  # off the rounding ties
query("tool_usage", S.with_audit("SELECT f.caller_id, tool, count(*) AS calls FROM (SELECT request_id, unnest(string_split(tools, ',')) AS tool FROM summaries WHERE tools IS NOT NULL) x JOIN firsts f USING (request_id) WHERE f.caller_id IS NOT NULL GROUP BY 1, 2", S.TURNS))(lambda a: T.tool_usage(T.turns(a)))
query("cost_by", S.with_audit(" UNION ALL ".join(f"SELECT '{d}' AS dimension, {k} AS key, round(sum(cost), 6) AS cost FROM summaries WHERE {k} IS NOT NULL GROUP BY 2" for d, k in (("model", "model"), ("caller", "caller_id"), ("day", "strftime(date, '%Y-%m-%d')"))), S.TURNS))(T.cost_by)
query("tokens_by_model", S.with_audit("SELECT model, sum(coalesce(prompt_tokens, 0))::BIGINT AS prompt, sum(coalesce(completion_tokens, 0))::BIGINT AS completion, sum(tokens)::BIGINT AS total FROM summaries GROUP BY 1", S.TURNS))(T.tokens_by_model)
query("session_cost", S.with_audit(f"SELECT * FROM ({S.percentiles('c', 'cost', 'cost')}) CROSS JOIN (SELECT round(avg(cost), 6) AS cost_avg FROM c)", S.TURNS + ", c AS (SELECT conversation_id, sum(cost) AS cost FROM turns WHERE conversation_id IS NOT NULL GROUP BY 1)"))(lambda a: T.session_cost(T.turns(a)))
query("turn_cost", S.with_audit("SELECT round(avg(cost), 6) AS cost_per_turn_avg FROM turns", S.TURNS))(lambda a: T.turn_cost(T.turns(a)))
query("blocked_before_upstream", S.with_audit("SELECT count(*) FILTER (WHERE action = 'block' AND at_request) AS blocked_before_upstream FROM summaries", S.TURNS))(T.blocked_before_upstream)
query(
    "metrics_history_row",
    S.with_audit(
        "SELECT * FROM (SELECT count(*) AS requests, " + ", ".join(f"count(*) FILTER (WHERE strength = {_COUNT[n]}) AS {n}" for n in OUT) + f" FROM requests) CROSS JOIN ({S.percentiles('requests', 'overhead_ms', 'overhead_ms')}) CROSS JOIN ({S.percentiles('requests', 'rules_overhead_ms', 'rules_overhead_ms')}) CROSS JOIN (SELECT sum(tokens)::BIGINT AS tokens_total, round(sum(cost), 6) AS cost_total FROM usage)"
        " CROSS JOIN (SELECT count(*) AS sessions FROM (SELECT DISTINCT caller_id, conversation_id FROM turns WHERE caller_id IS NOT NULL AND conversation_id IS NOT NULL)) CROSS JOIN (SELECT count(*) AS turns FROM turns WHERE caller_id IS NOT NULL)",
        S.REQUESTS + S.USAGE + S.TURNS,
    ),
)(lambda a: T.history_row(M.requests(a), M.usage_rows(a), T.agents(T.turns(a))))
query(
    "caller_day_measures",
    S.with_audit(
        "SELECT caller_id, strftime(date, '%Y-%m-%d') AS date, count(DISTINCT request_id) AS turns, count(DISTINCT CASE WHEN at_request THEN conversation_id END) AS sessions, round(coalesce(CAST(count(DISTINCT CASE WHEN is_block THEN request_id END) AS DOUBLE) / nullif(count(DISTINCT request_id), 0), 0), 6) AS block_rate, round(sum(cost), 6) AS cost, "
        "round(coalesce(sum(coalesce(overhead_ms, 0)) / nullif(sum(coalesce(overhead_ms, 0)) + sum(coalesce(upstream_latency_ms, 0)), 0), 0), 6) AS overhead_share FROM summaries WHERE caller_id IS NOT NULL GROUP BY 1, 2",
        S.TURNS,
    ),
)(T.measures)
query("request_trace", S.with_audit("""SELECT request_id, checkpoint, coalesce(string_agg("check" || ':' || action, ',' ORDER BY id) FILTER (WHERE "check" <> 'turn_summary'), '') AS checks, max(CASE WHEN "check" = 'turn_summary' THEN reason END) AS summary, max(tokens) AS tokens, round(max(cost), 6) AS cost FROM audit WHERE request_id IS NOT NULL AND checkpoint IS NOT NULL GROUP BY 1, 2"""))(T.request_trace)
query(
    "live_turns",
    S.with_audit(
        """SELECT request_id, max(id) AS last_id, CASE WHEN count(*) FILTER (WHERE "check" = 'upstream_unavailable') > 0 THEN 'failed'
  WHEN NOT (count(*) FILTER (WHERE "check" = 'turn_summary' AND NOT at_request) > 0 OR coalesce(max(CASE WHEN "check" = 'turn_summary' THEN strength END) = 3, false)) THEN 'running'
  ELSE ['allow', 'flag', 'redact', 'block'][max(CASE WHEN "check" = 'turn_summary' THEN strength END) + 1] END AS state,
  round(sum(CASE WHEN "check" = 'turn_summary' AND at_request THEN overhead_ms END), 6) AS pre_ms, round(sum(CASE WHEN "check" = 'turn_summary' THEN upstream_latency_ms END), 6) AS model_ms,
  round(sum(CASE WHEN "check" = 'turn_summary' AND NOT at_request THEN overhead_ms END), 6) AS post_ms FROM audit WHERE request_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC LIMIT 60"""
    ),
)(T.live_turns)


def _enabled(a: DataFrame) -> DataFrame:
    """The matrix of the checks as the log shows them: on where a check ever blocked, at the checkpoints where it has rows."""
    rows = M.check_rows(a).filter("checkpoint IS NOT NULL")
    checks = rows.groupBy("check").agg(F.max("is_block").alias("on"), F.collect_set("checkpoint").alias("at"))
    return M.enabled_checks(checks, rows.select("checkpoint").distinct())


query("enabled_checks", S.with_audit("""SELECT k."check", p.checkpoint, CASE WHEN NOT (k.is_on AND list_contains(k.places, p.checkpoint)) THEN 'off' WHEN k."check" = 'pii_secrets' THEN 'redact' ELSE 'block' END AS mode
  FROM (SELECT "check", bool_or(is_block) AS is_on, list(DISTINCT checkpoint) AS places FROM checks WHERE checkpoint IS NOT NULL GROUP BY 1) k, (SELECT DISTINCT checkpoint FROM checks WHERE checkpoint IS NOT NULL) p""", S.CHECK_ROWS))(_enabled)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["timeline"](spark, sf_dir)

