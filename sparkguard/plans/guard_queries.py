"""Registered queries of access, budgets, loops, chat logs and browsing, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import access, browse, budget, chat
from ..operators import metrics as M
from . import sql as S
from . import views as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def wrap(f):
        QUERIES[name] = lambda spark, sf_dir: V.rounded(f(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return wrap


def _values(rows) -> str:
    cell = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


_ROLES = """roles AS (SELECT caller_id, unnest(CASE WHEN user_id % 7 = 0 THEN [first, 'analyst'] ELSE [first] END) AS role FROM
  (SELECT DISTINCT user_id, 'u' || user_id AS caller_id, CASE WHEN user_id % 5 = 0 THEN 'nobody' WHEN user_id % 3 = 0 THEN 'developer' ELSE 'support' END AS first FROM events))"""
_GRANTS = f"""{_ROLES}, rp AS (SELECT * FROM (VALUES {_values(V.ROLE_PERMISSIONS)}) AS t(role, permission)), pt AS (SELECT * FROM (VALUES {_values(V.PERMISSION_TOOLS)}) AS t(permission, tool)),
grants AS (SELECT DISTINCT caller_id, tool FROM roles JOIN rp USING (role) JOIN pt USING (permission))"""
_CALLS = f"""{_GRANTS}, calls AS (SELECT 'u' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS request_id, 'u' || user_id AS caller_id, event_id AS position,
  [{", ".join(f"'{t}'" for t in V.TOOLS)}][CAST(event_id % {len(V.TOOLS)} + 1 AS INTEGER)] AS name, event_type || '/' || (event_id % 4) AS args FROM events),
split AS (SELECT c.*, g.tool IS NOT NULL AS allowed FROM calls c LEFT JOIN grants g ON g.caller_id = c.caller_id AND g.tool = c.name)"""
_BUDGETS = f"""{_ROLES}, rb AS (SELECT * FROM (VALUES {_values(V.ROLE_BUDGETS)}) AS t(role, requests_per_minute, tokens_per_day, cost_per_day)),
budgets AS (SELECT caller_id, count(rb.role) > 0 AS has_budget, {", ".join(f"CASE WHEN count(*) FILTER (WHERE rb.role IS NOT NULL AND {c} IS NULL) = 0 THEN max({c}) END AS {c}" for c in budget.LIMITS)}
  FROM roles LEFT JOIN rb USING (role) GROUP BY caller_id)"""
_USED = """, uses AS (SELECT 'u' || user_id AS caller_id, event_id AS id, ts, event_id % 4 <> 3 AS forwarded, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS tokens, value / 1000 AS cost FROM events),
used AS (SELECT a.caller_id, a.id, (SELECT count(*) FROM uses b WHERE b.caller_id = a.caller_id AND b.forwarded AND b.id <> a.id AND b.ts > a.ts - INTERVAL 60 SECONDS AND b.ts <= a.ts) AS requests_last_minute,
  CAST(coalesce(sum(tokens) OVER w, 0) AS BIGINT) AS tokens_today, coalesce(sum(cost) OVER w, 0) AS cost_today FROM uses a
  WINDOW w AS (PARTITION BY caller_id, CAST(ts AS DATE) ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _grants(spark: SparkSession, d: str) -> DataFrame:
    p = V.policy_tables(spark)
    return access.allowed_tools(V.caller_roles(spark, d), p["role_permissions"], p["permission_tools"])


def _uses(spark: SparkSession, d: str) -> DataFrame:
    e = V.read(spark, d, "events")
    return e.select(F.concat(F.lit("u"), "user_id").alias("caller_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts_utc"), (F.col("event_id") % 4 != 3).alias("forwarded"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("tokens"), (F.col("value") / 1000).alias("cost"))


def _budgets(spark: SparkSession, d: str) -> DataFrame:
    return budget.effective_budget(V.caller_roles(spark, d), V.policy_tables(spark)["role_budgets"])


query("allowed_tools", f"WITH {_GRANTS} SELECT caller_id, tool FROM grants")(_grants)
query("rbac_decisions", f"""WITH {_CALLS} SELECT request_id, caller_id, position, 'rbac' AS "check", CASE WHEN allowed THEN 'allow' ELSE 'block' END AS action, 'tool ' || name || CASE WHEN allowed THEN ' allowed' ELSE ' denied' END AS reason FROM split""")(lambda s, d: access.decision_rows(V.calls(s, d), _grants(s, d)))
query("tool_offer_filter", f"WITH {_CALLS} SELECT request_id, coalesce(string_agg(name, ',' ORDER BY position) FILTER (WHERE allowed), '') AS kept, coalesce(string_agg(name, ',' ORDER BY position) FILTER (WHERE NOT allowed), '') AS removed FROM split GROUP BY 1")(lambda s, d: access.filter_tools(V.calls(s, d), _grants(s, d)))
query(
    "tool_call_denials",
    f"""WITH {_CALLS}, f AS (SELECT request_id, name, min(position) AS position FROM split WHERE NOT allowed GROUP BY 1, 2), n AS (SELECT request_id, 'Tools not allowed: ' || string_agg(name, ', ' ORDER BY position) AS notice FROM f GROUP BY 1)
  SELECT request_id, count(*) FILTER (WHERE allowed) AS calls_left, count(*) FILTER (WHERE NOT allowed) AS calls_denied, max(notice) AS notice FROM split JOIN n USING (request_id) GROUP BY 1""",
)(lambda s, d: access.deny_calls(V.calls(s, d), _grants(s, d)))


def _permission_requests(spark: SparkSession, d: str) -> DataFrame:
    a = V.audit(spark, d).filter("request_id IS NOT NULL AND checkpoint IS NOT NULL")
    return a.groupBy("request_id").agg(F.max_by("checkpoint", "id").alias("checkpoint"), F.max_by("model", "id").alias("model"))


query(
    "check_permissions",
    S.with_audit(
        f"""SELECT r.request_id, checkpoint, model, CASE WHEN checkpoint = 'tool_call' AND coalesce(n, 0) = 0 THEN 'error' WHEN (checkpoint = 'tool_call' AND coalesce(denied, '') <> '') OR (at_request AND model <> 'gemma4') THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN checkpoint = 'tool_call' AND coalesce(n, 0) = 0 THEN 'no tool calls' WHEN checkpoint = 'tool_call' AND coalesce(denied, '') <> '' THEN 'tools not allowed: ' || denied WHEN at_request AND model <> 'gemma4' THEN 'model not allowed: ' || model ELSE '' END AS reason
  FROM (SELECT * FROM (SELECT request_id, checkpoint, model, at_request, row_number() OVER (PARTITION BY request_id ORDER BY id DESC) AS rn FROM audit WHERE request_id IS NOT NULL AND checkpoint IS NOT NULL) WHERE rn = 1) r
  LEFT JOIN (SELECT request_id, count(*) AS n, string_agg(DISTINCT name, ', ' ORDER BY name) FILTER (WHERE NOT allowed) AS denied FROM split GROUP BY 1) x USING (request_id)""",
        ", " + _CALLS,
    ),
)(lambda s, d: access.check_permissions(_permission_requests(s, d), V.calls(s, d), _grants(s, d), ["gemma4"]))
query(
    "check_loops",
    f"""WITH {_CALLS}, same AS (SELECT request_id, name, args, count(*) AS n, min(position) AS first FROM calls GROUP BY 1, 2, 3), f AS (SELECT request_id, CAST(sum(n) AS BIGINT) AS calls, max(n) AS repeats FROM same GROUP BY 1),
  m AS (SELECT request_id, name FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY n DESC, first) AS rn FROM same) WHERE rn = 1)
  SELECT request_id, calls, repeats, CASE WHEN calls > 4 OR repeats > 1 THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN calls > 4 THEN 'too many tool calls: ' || calls WHEN repeats > 1 THEN name || ' repeated ' || repeats || ' times' ELSE '' END AS reason FROM f JOIN m USING (request_id)""",
)(lambda s, d: access.check_loops(V.calls(s, d), 4, 1))
query("effective_budget", f"WITH {_BUDGETS} SELECT caller_id, has_budget, CAST(requests_per_minute AS BIGINT) AS requests_per_minute, CAST(tokens_per_day AS BIGINT) AS tokens_per_day, CAST(cost_per_day AS DOUBLE) AS cost_per_day FROM budgets")(_budgets)
query("usage_so_far", f"WITH {_ROLES}{_USED} SELECT caller_id, id, requests_last_minute, tokens_today, round(cost_today, 6) AS cost_today FROM used")(lambda s, d: budget.usage_so_far(_uses(s, d)).drop("ts_utc", "forwarded", "tokens", "cost"))
query(
    "check_budget",
    f"""WITH {_BUDGETS}{_USED} SELECT caller_id, id, CASE WHEN NOT has_budget THEN 'no budgeted role' ELSE concat_ws('; ', CASE WHEN requests_last_minute >= requests_per_minute THEN 'requests_per_minute' END, CASE WHEN tokens_today >= tokens_per_day THEN 'tokens_per_day' END,
  CASE WHEN round(cost_today, 9) >= cost_per_day THEN 'cost_per_day' END) END AS reason FROM used JOIN budgets USING (caller_id)""",
)(lambda s, d: budget.check_budget(budget.usage_so_far(_uses(s, d)).withColumn("cost_today", F.round("cost_today", 9)), _budgets(s, d)).select("caller_id", "id", "reason"))
_REPLAY = f"""WITH RECURSIVE {_BUDGETS}, e AS (SELECT 'u' || user_id AS caller_id, event_id AS id, epoch_us(ts) / 1e6 AS sec, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS tokens, value / 1000 AS cost,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
h AS (SELECT e.*, has_budget, requests_per_minute AS rpm, tokens_per_day AS tpd, cost_per_day AS cpd FROM e JOIN budgets USING (caller_id)),
r AS (SELECT DISTINCT caller_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, '' AS day, CAST(0 AS BIGINT) AS tokens, CAST(0 AS DOUBLE) AS cost, CAST([] AS DOUBLE[]) AS recent, '' AS verdict FROM h
UNION ALL SELECT caller_id, n, id, day, CASE WHEN blocked THEN t ELSE t + tokens END, CASE WHEN blocked THEN c ELSE c + cost END, CASE WHEN blocked THEN kept ELSE list_append(kept, sec) END, CASE WHEN blocked THEN 'block' ELSE 'allow' END FROM
  (SELECT *, NOT has_budget OR coalesce(len(kept) >= rpm, false) OR coalesce(t >= tpd, false) OR coalesce(c >= cpd, false) AS blocked FROM
    (SELECT h.*, CASE WHEN r.day = h.day THEN r.tokens ELSE 0 END AS t, CASE WHEN r.day = h.day THEN r.cost ELSE 0 END AS c, list_filter(r.recent, lambda x: x > h.sec - 60) AS kept FROM r JOIN h ON h.caller_id = r.caller_id AND h.n = r.n + 1)))
SELECT caller_id, id, verdict FROM r WHERE n > 0"""
query("budget_replay", _REPLAY)(lambda s, d: budget.replay(_uses(s, d), _budgets(s, d)))
query(
    "quotas",
    """WITH c AS (SELECT event_type AS key, event_id AS id, floor(epoch(ts) / 3600) AS h, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY key, floor(epoch(ts) / 60) ORDER BY ts, id) AS n, floor(epoch(ts) / 60) AS m FROM c),
  t AS (SELECT key, m, least(count(*), 1) AS taken FROM r GROUP BY 1, 2), b AS (SELECT key, m, coalesce(sum(taken) OVER (PARTITION BY key ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
  SELECT key, id, n <= 1 AND before + n <= 1500 AS allowed FROM r JOIN b USING (key, m)""",
)(lambda s, d: budget.quotas(V.read(s, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts_utc")), 1, 1500).drop("ts_utc"))

_MESSAGES = """messages AS (SELECT 'c' || conv_id AS request_id, turn AS message_index, CASE WHEN role = 'assistant' AND (conv_id + turn) % 3 = 0 THEN 'tool' ELSE role END AS role, text AS content FROM conversations)"""
query("request_checkpoints", f"WITH {_MESSAGES} SELECT request_id, CASE WHEN arg_max(role, message_index) = 'tool' THEN 'tool_result' ELSE 'input' END AS checkpoint, count(*) AS messages FROM messages GROUP BY 1")(lambda s, d: chat.request_checkpoints(V.messages(s, d)))
query(
    "conversation_ids",
    f"WITH {_MESSAGES}, c AS (SELECT request_id, 'u' || (length(request_id) % 3) AS caller_id, coalesce(arg_min(content, message_index) FILTER (WHERE role = 'user' AND content IS NOT NULL), '') AS first FROM messages GROUP BY 1) SELECT request_id, left(sha256(caller_id || chr(0) || first), 16) AS conversation_id FROM c",
)(lambda s, d: chat.sessions(V.messages(s, d), V.messages(s, d).select("request_id").distinct().withColumn("caller_id", F.concat(F.lit("u"), (F.length("request_id") % 3).cast("string")))))
query("scan_targets_all", f"WITH {_MESSAGES} SELECT request_id, message_index FROM messages WHERE content IS NOT NULL AND content <> '' AND role <> 'system'")(lambda s, d: chat.scan_targets(V.messages(s, d), skip_roles=("system",)).select("request_id", "message_index"))
query(
    "scan_targets_new",
    f"""WITH {_MESSAGES}, k AS (SELECT request_id, max(message_index) FILTER (WHERE role <> 'tool') AS o, max(message_index) FILTER (WHERE role = 'user') AS u, max(message_index) AS l FROM messages GROUP BY 1)
  SELECT request_id, message_index FROM messages JOIN k USING (request_id) WHERE content <> '' AND CASE WHEN l > coalesce(o, -1) THEN message_index > coalesce(o, -1) ELSE message_index = u END""",
)(lambda s, d: chat.scan_targets(V.messages(s, d), "new").select("request_id", "message_index"))
query("step_numbers", f"WITH {_MESSAGES} SELECT request_id, message_index, count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY request_id ORDER BY message_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS step FROM messages")(lambda s, d: access.step_numbers(V.messages(s, d)).select("request_id", "message_index", "step"))

query("audit_search", S.with_audit("""SELECT id, request_id, "check", action FROM audit WHERE caller_id = 'u8' AND action = 'block' AND ts_utc >= TIMESTAMP '2024-01-03 00:00:00' AND ts_utc <= TIMESTAMP '2024-01-25 12:00:00'"""))(lambda s, d: browse.search(V.audit(s, d), "2024-01-03T00:00:00Z", "2024-01-25T12:00:00Z", caller_id="u8", action="block").select("id", "request_id", "check", "action"))
query("audit_page", S.with_audit('SELECT id, caller_id, "check", action FROM audit ORDER BY id DESC LIMIT 100 OFFSET 200'))(lambda s, d: browse.page(V.audit(s, d), 200, 100).select("id", "caller_id", "check", "action"))
query("threat_feed", S.with_audit("""SELECT id, "check", action FROM (SELECT * FROM audit ORDER BY id DESC LIMIT 200) WHERE action <> 'allow' AND checkpoint IS NOT NULL AND "check" <> 'turn_summary' ORDER BY id DESC LIMIT 30"""))(lambda s, d: browse.threat_feed(V.audit(s, d)).select("id", "check", "action"))
query("live_backlog", S.with_audit("SELECT id, action FROM audit WHERE ts_utc >= TIMESTAMP '2024-01-20 02:00:00' AND ts_utc <= TIMESTAMP '2024-01-20 12:00:00' ORDER BY id DESC LIMIT 300"))(lambda s, d: browse.backlog(V.audit(s, d), "2024-01-20T12:00:00Z", minutes=600).select("id", "action"))
query(
    "threat_bins",
    S.with_audit(
        "SELECT CAST(floor((epoch(date_trunc('minute', first_ts)) - epoch(TIMESTAMP '2024-01-05 00:00:00')) / 864000.0 * 12) AS BIGINT) AS bin, count(*) AS requests, count(*) FILTER (WHERE strength = 3) AS blocked, count(*) FILTER (WHERE strength = 2) AS redacted, count(*) FILTER (WHERE strength = 1) AS flagged FROM requests WHERE first_ts >= TIMESTAMP '2024-01-05 00:00:00' AND first_ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1",
        S.REQUESTS,
    ),
)(lambda s, d: browse.threat_bins(M.timeline(M.requests(V.audit(s, d))), "2024-01-05T00:00:00Z", "2024-01-15T00:00:00Z"))
query(
    "guardrail_traces",
    S.with_audit(
        """SELECT a.request_id, id, concat_ws('/', checkpoint, "check") AS name, CASE WHEN is_block THEN 'ERROR' WHEN action IN ('redact', 'flag') THEN 'WARNING' ELSE 'DEFAULT' END AS level, round(CASE WHEN decided_by IN ('jev', 'fallback') THEN score END, 6) AS risk, CASE WHEN is_block THEN "check" END AS blocked_by, tags
  FROM audit a JOIN (SELECT request_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (SELECT request_id, unnest([action, CASE WHEN is_block THEN 'blocked_by:' || "check" END, CASE WHEN is_system_event THEN 'system_event' END]) AS tag FROM audit WHERE request_id IS NOT NULL) WHERE tag IS NOT NULL GROUP BY 1) t ON a.request_id = t.request_id"""
    ),
)(lambda s, d: browse.guardrail_traces(V.audit(s, d)))
query("model_costs", f"""WITH p AS (SELECT * FROM (VALUES {_values(V.PRICES)}) AS t(model, price)), {S.AUDIT} SELECT model, round(sum(CAST(tokens AS DOUBLE) / 1000 * coalesce(price, 0)), 6) AS cost FROM audit LEFT JOIN p USING (model) GROUP BY 1""")(
    lambda s, d: V.audit(s, d).join(F.broadcast(V.policy_tables(s)["prices"]), "model", "left").groupBy("model").agg(F.sum(C.cost_of(F.col("tokens"), F.col("price_per_1k"))).alias("cost"))
)
