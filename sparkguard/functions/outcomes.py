"""What a row's helper gives: a value, or an error and its reason. Scans fail closed: an error is a row that blocks, never a lost row or a dead job."""

from __future__ import annotations

import gc
from collections.abc import Callable
from dataclasses import dataclass
from typing import Generic, TypeVar

T = TypeVar("T")


@dataclass(frozen=True, slots=True)
class Outcome(Generic[T]):
    value: T | None = None
    error: str | None = None
    reason: str | None = None


def attempt(helper: Callable[..., T], *args) -> Outcome[T]:
    """What helper gives for args, or the kind of its exception; running out of memory, twice, or stack is an error of the row as well."""
    try:
        try:
            return Outcome(helper(*args))
        except MemoryError:  # what rows before it left may fill the memory, and isn't about this row
            gc.collect()
        return Outcome(helper(*args))
    except Exception as e:  # whatever a helper raises is about its row
        return Outcome(None, type(e).__name__, str(e)[:200])


def storable(text: str) -> str:
    """Text that UTF-8 can hold: halves of surrogate pairs, which JSON escapes can spell, become U+FFFD."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
