"""Explicit schemas of the logged tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

CHECKPOINTS = ("input", "tool_call", "tool_result", "output")
REQUEST_CHECKPOINTS = ("input", "tool_result")
#: From weakest to strongest.
ACTIONS = ("allow", "flag", "redact", "block")
OUTCOMES = {"allow": "allowed", "flag": "flagged", "redact": "redacted", "block": "blocked"}
DECIDED_BY = ("rules", "jev", "fallback")
JUDGE = "jev"
TURN_SUMMARY = "turn_summary"
#: Rows that report on the service, not on a request.
SYSTEM_EVENTS = ("bad_request", "upstream_unavailable", "policy_loaded", "policy_rejected", "signature_feed_updated", "signature_feed_failed", TURN_SUMMARY)
#: Checks in cost order.
CHECKS = ("permissions", "budget", "loop_detection", "signatures", "tool_args", "pii_secrets", "jev")

_T = {"s": StringType(), "l": LongType(), "d": DoubleType()}
_FIELDS = (
    "id:l ts:s request_id:s caller_id:s model:s checkpoint:s check:s action:s reason:s score:d latency_ms:d decided_by:s tokens:l cost:d policy_version:s "
    "conversation_id:s step:l messages:l tool_calls:l tools:s tool_calls_total:l prompt_tokens:l completion_tokens:l upstream_latency_ms:d overhead_ms:d blocked_by:s"
)
#: One row of the audit log as it is written; ts is ISO 8601 text.
AUDIT = StructType([StructField(n, _T[t]) for n, t in (f.split(":") for f in _FIELDS.split())])
REQUIRED = ("ts", "check", "action", "reason", "score", "latency_ms", "decided_by", "tokens", "cost", "policy_version")
DERIVED = ("date", "hour", "minute", "is_block", "is_redact", "is_flag", "is_system_event", "category")

SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("replacement", StringType())])
CLIENTS = "client_id string, name string, country string, sector string"
CONTACTS = "contact_id string, client_id string, name string, email string, phone string, identifier_kind string, identifier string"
ACCOUNTS = "account_id string, client_id string, iban string, currency string, opening_balance_minor bigint"
TRANSACTIONS = "transaction_id string, account_id string, client_id string, counterparty string, amount_minor bigint, currency string, direction string, status string, booked_at timestamp, reference string"
DOCUMENTS = "document_id string, client_id string, title string, document_type string, classification string, source string, created_at timestamp, transaction_ids array<string>"
SPANS = ArrayType(SPAN)
