"""Column expressions; all built-in, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ACTIONS, CHECKPOINTS, JUDGE, REQUEST_CHECKPOINTS, SYSTEM_EVENTS


def utc(ts: str = "ts") -> Column:
    """Timestamp of ISO 8601 text: an offset is converted, a naive value is UTC; bad text gives null."""
    return F.try_to_timestamp(F.col(ts).cast("string"))


def minute_text(ts: Column) -> Column:
    return F.date_format(F.date_trunc("minute", ts), "yyyy-MM-dd'T'HH:mm:'00Z'")


def category(check: str = "check", reason: str = "reason") -> Column:
    """Attack category that a signature or judge reason names."""
    by_signature = F.regexp_extract(reason, r"^signature \S+ \(([^()]+)\):", 1)
    by_judge = F.trim(F.split(F.regexp_extract(reason, r"\[([^\[\]]+)\]\s*$", 1), ",")[0])
    return F.nullif(F.when(F.col(check) == "signatures", by_signature).when(F.col(check) == JUDGE, by_judge), F.lit(""))


def is_system_event(check: str = "check", checkpoint: str = "checkpoint") -> Column:
    return F.col(check).isin(*SYSTEM_EVENTS) | F.col(checkpoint).isNull()


def strength(action: str = "action") -> Column:
    """0 to 3, allow < flag < redact < block."""
    return F.array_position(F.array(*map(F.lit, ACTIONS)), F.col(action)).cast("int") - 1


def action_of(strongest: str | Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ACTIONS)), (F.col(strongest) if isinstance(strongest, str) else strongest) + 1)


def at_request(checkpoint: str = "checkpoint") -> Column:
    return F.coalesce(F.col(checkpoint).isin(*REQUEST_CHECKPOINTS), F.lit(False))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0 or null."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def conversation_id(caller: str, first_user_message: str) -> Column:
    """First 16 hex digits of SHA-256 over caller, a zero character and the first user message."""
    return F.substring(F.sha2(F.concat(F.coalesce(caller, F.lit("")), F.char(F.lit(0)), F.coalesce(first_user_message, F.lit(""))), 256), 1, 16)


def safe_label(name: str | Column) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.when(name.rlike(r"\A[A-Za-z_][A-Za-z0-9_.:-]{0,63}\z"), name).otherwise("<unprintable name>")


def verdict_action(verdict: str = "verdict") -> Column:
    """An error blocks, as a block does."""
    return F.when(F.col(verdict).isin("block", "error"), "block").otherwise(F.col(verdict))


def cost_of(tokens: Column, price: Column) -> Column:
    return tokens / 1000 * F.coalesce(price, F.lit(0.0))


def valid_checkpoint(checkpoint: str = "checkpoint") -> Column:
    return F.col(checkpoint).isNull() | F.col(checkpoint).isin(*CHECKPOINTS)


def iban_valid(iban: str | Column) -> Column:
    """Length and mod 97 of an IBAN; spaces are ignored. Digits are folded, as the number exceeds a decimal."""
    plain = F.upper(F.regexp_replace(iban, r"\s", ""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    digit = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + digit(c)) % 97).otherwise((acc * 100 + digit(c)) % 97))
    return plain.rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z") & (rest == 1)


def pesel_valid(pesel: str | Column) -> Column:
    """Weighted checksum of the eleven digits of a PESEL."""
    digits = F.transform(F.filter(F.split(pesel, ""), lambda c: c != ""), lambda c: c.cast("int"))
    weights = F.array(*map(F.lit, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1)))  # fixed values: the published weights
    total = F.aggregate(F.zip_with(digits, weights, lambda d, w: d * w), F.lit(0), lambda acc, x: acc + x)
    return F.coalesce(F.col(pesel) if isinstance(pesel, str) else pesel, F.lit("")).rlike(r"\A[0-9]{11}\z") & (total % 10 == 0)
