"""The same views in SQL, for checking queries against another engine."""

from __future__ import annotations

from ..schemas import CHECKS, SYSTEM_EVENTS


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


AUDIT = f"""e0 AS (SELECT *, CASE event_type WHEN 'view' THEN 'input' WHEN 'signup' THEN 'tool_result' WHEN 'click' THEN 'tool_call' WHEN 'purchase' THEN 'output' END AS checkpoint,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type IN ('click', 'purchase') AS reply FROM events),
e1 AS (SELECT *, CASE WHEN checkpoint IS NULL THEN CASE WHEN event_id % 2 = 0 THEN 'upstream_unavailable' ELSE 'auth_failed' END
  WHEN event_id % 3 = 0 THEN 'turn_summary' ELSE {_list(CHECKS)}[CAST(event_id % 7 + 1 AS INTEGER)] END AS "check",
  ['prompt_injection', 'exfiltration', 'code_execution'][CAST(event_id % 3 + 1 AS INTEGER)] AS topic FROM e0),
e2 AS (SELECT event_id AS id, ts AS ts_utc, CASE WHEN event_id % 97 <> 0 THEN 'u' || user_id || '-' || strftime(ts, '%Y-%m-%d') END AS request_id,
  CASE WHEN event_id % 89 <> 0 THEN 'u' || user_id END AS caller_id, CASE WHEN event_id % 2 = 0 THEN 'gpt-4o-mini' ELSE 'gemma4' END AS model, checkpoint, "check",
  CASE WHEN value >= 120 THEN 'block' WHEN value >= 80 THEN 'redact' WHEN value >= 60 THEN 'flag' ELSE 'allow' END AS action,
  CASE "check" WHEN 'signatures' THEN 'signature SIG-' || (event_id % 5) || ' (' || topic || '): matched' WHEN 'jev' THEN 'risk [' || topic || ', other]' ELSE 'ok' END AS reason,
  value / 250 AS score, value AS latency_ms, CASE WHEN "check" = 'jev' THEN CASE WHEN event_id % 5 = 0 THEN 'fallback' ELSE 'jev' END ELSE 'rules' END AS decided_by,
  CASE WHEN reply THEN k ELSE 0 END AS tokens, CASE WHEN reply AND event_id % 2 = 0 THEN CAST(k AS DOUBLE) / 1000 * 0.0006 ELSE 0.0 END AS cost,
  '0.' || (event_id % 2 + 1) AS policy_version, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, strftime(ts, '%Y-%m-%dT%H:%M:00Z') AS minute, user_id, value, topic FROM e1),
audit AS (SELECT *, action = 'block' AS is_block, action = 'redact' AS is_redact, action = 'flag' AS is_flag,
  "check" IN ({", ".join(f"'{x}'" for x in SYSTEM_EVENTS)}) OR checkpoint IS NULL AS is_system_event, checkpoint IN ('input', 'tool_result') AS at_request,
  CASE action WHEN 'allow' THEN 0 WHEN 'flag' THEN 1 WHEN 'redact' THEN 2 ELSE 3 END AS strength, CASE WHEN "check" IN ('signatures', 'jev') THEN topic END AS category,
  CASE WHEN "check" = 'turn_summary' AND id % 11 <> 0 THEN 's' || user_id || '-' || (day(ts_utc) % 7) END AS conversation_id,
  CASE WHEN "check" = 'turn_summary' THEN id % 5 END AS step, CASE WHEN "check" = 'turn_summary' THEN id % 9 + 1 END AS messages,
  CASE WHEN "check" = 'turn_summary' AND checkpoint = 'tool_call' THEN user_id % 4 END AS tool_calls,
  CASE WHEN "check" = 'turn_summary' AND checkpoint = 'tool_call' THEN CASE user_id % 4 WHEN 1 THEN 'run_shell' WHEN 2 THEN 'query_customers,run_shell' WHEN 3 THEN 'query_customers,run_shell,read_file' END END AS tools,
  CASE WHEN "check" = 'turn_summary' AND checkpoint IN ('tool_call', 'output') THEN tokens * 3 // 4 END AS prompt_tokens,
  CASE WHEN "check" = 'turn_summary' AND checkpoint IN ('tool_call', 'output') THEN tokens - tokens * 3 // 4 END AS completion_tokens,
  CASE WHEN "check" = 'turn_summary' AND checkpoint IN ('tool_call', 'output') AND id % 4 <> 1 THEN value * 10 END AS upstream_latency_ms,
  CASE WHEN "check" = 'turn_summary' THEN value / 10 END AS overhead_ms FROM e2)"""

CHECK_ROWS = """, checks AS (SELECT * FROM audit WHERE NOT is_system_event)"""
REQUESTS = (
    CHECK_ROWS
    + """, requests AS (SELECT request_id, max(strength) AS strength, min(ts_utc) AS first_ts, sum(latency_ms) AS overhead_ms,
  sum(CASE WHEN "check" <> 'jev' THEN latency_ms ELSE 0 END) AS rules_overhead_ms FROM checks WHERE request_id IS NOT NULL GROUP BY request_id)"""
)
USAGE = """, usage AS (SELECT request_id, caller_id, date, tokens, cost, id FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY tokens DESC, cost DESC, id) AS rn FROM audit WHERE request_id IS NOT NULL) WHERE rn = 1
  UNION ALL SELECT request_id, caller_id, date, tokens, cost, id FROM audit WHERE request_id IS NULL)"""
TURNS = """, summaries AS (SELECT * FROM audit WHERE "check" = 'turn_summary'),
firsts AS (SELECT request_id, caller_id, conversation_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY NOT coalesce(at_request, false), id) AS rn FROM summaries WHERE request_id IS NOT NULL) WHERE rn = 1),
sums AS (SELECT request_id, max(strength) AS strength, sum(coalesce(tool_calls, 0)) AS tool_calls, sum(tokens) AS tokens, sum(cost) AS cost, sum(upstream_latency_ms) AS upstream_ms,
  sum(coalesce(overhead_ms, 0)) AS overhead_ms, sum(CASE WHEN at_request THEN coalesce(overhead_ms, 0) ELSE 0 END) AS pre_ms, sum(CASE WHEN NOT at_request THEN coalesce(overhead_ms, 0) END) AS post_ms
  FROM summaries WHERE request_id IS NOT NULL GROUP BY request_id),
turns AS (SELECT *, ['allow', 'flag', 'redact', 'block'][strength + 1] AS action FROM firsts JOIN sums USING (request_id))"""


def percentiles(source: str, value: str, name: str, by: str | None = None) -> str:
    """A SELECT of nearest-rank p50 and p95 of value, per key or as one row (0 without rows)."""
    part = f"PARTITION BY {by}" if by else ""
    ranked = f'SELECT *, row_number() OVER ({part} ORDER BY {value}) AS rn, count(*) OVER ({part}) AS n FROM {source} WHERE {value} IS NOT NULL'
    cols = ", ".join(f"round(coalesce(max(CASE WHEN rn = greatest(1, ({p} * n + 99) // 100) THEN {value} END), 0.0), 6) AS {name}_p{p}" for p in (50, 95))
    return f"SELECT {by + ', ' if by else ''}{cols} FROM ({ranked})" + (f" GROUP BY {by}" if by else "")


def with_audit(body: str, *parts: str) -> str:
    return f"WITH {AUDIT}{''.join(parts)} {body}"
