"""Secret scanning with multipart credential linking.

Base spans are strong by themselves: assignments of a long value to a secret-like name, access identifiers, and long
hexadecimal runs. Other parts are weak: client identifiers, opaque tokens that mix letters and digits, and endpoints (URLs
and IPv4 addresses). A part's interval is widened by SCOPE characters and cut at the next blank line; one sweep over the ends
and starts of a document's parts joins the intervals. A weak part is reported only if a complementary part stands in its
scope: identifier + token or endpoint + token, where access identifiers count as identifiers, assignments and hexadecimal
runs as tokens. An identifier and an endpoint alone are not a credential.

Offsets are code points, ends exclusive. Null text counts as empty and has no spans. Whole texts are scanned, in time that
grows with their length. Ties: spans with one start are ordered by kind as listed in KINDS, then by end. Equal spans of one kind are
reported once; rows are independent, so repeated rows repeat their result, and null doc_ids are carried. An empty table gives no
rows. redact() hides identifiers and secrets, not endpoints, and keeps all columns; scan() reads no others than it is told to keep.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

KINDS = ("assign", "access", "hex", "client", "token", "endpoint")
_COMPLEMENTS = {"client": ("token",), "endpoint": ("token",), "token": ("client", "endpoint")}
_ROLES = {"assign": "token", "access": "client", "hex": "token"}
#: Two parts further apart than so many characters are never linked.
SCOPE = 200

# The base patterns and their least lengths.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

_CLIENT = re.compile(r"(?:client|account|access|key)[_-]?id[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._-]{8,})", re.IGNORECASE | re.ASCII)
_ENDPOINT = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]{4,}|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_BLANK = re.compile(r"\n[\x20\t\r]*\n")
_LONG_WORD = re.compile(r"[A-Za-z0-9+/_-]{20}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    low = text.lower() if ":" in text or "=" in text else ""
    if any(k in low for k in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def _opaque(value: str) -> bool:
    """Mixes digits with lower and upper case, and isn't a path or a repeated pattern."""
    return any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value) and len(set(value)) >= 10


class _Taken:
    """Disjoint ranges that no weak part may overlap."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, s: int, e: int) -> bool:
        i = bisect_left(self.starts, e) - 1
        return i < 0 or self.ends[i] <= s


def weak_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Client identifiers and opaque tokens that overlap no base span, and endpoints."""
    strong = [(s, e) for _, s, e in base]
    taken = _Taken(strong)
    clients = [("client", m.start(1), m.end(1)) for m in _CLIENT.finditer(text) if taken.free(m.start(1), m.end(1))] if "id" in text.lower() else []
    taken = _Taken(strong + [(s, e) for _, s, e in clients])
    tokens = [("token", m.start(), m.end()) for m in _TOKEN.finditer(text) if _opaque(m[0]) and taken.free(m.start(), m.end())] if _LONG_WORD.search(text) else []
    if not clients and not tokens and not base:
        return []
    return clients + tokens + [("endpoint", m.start(), m.end()) for m in _ENDPOINT.finditer(text)]


def linked_spans(text: str, base: list[tuple[str, int, int]], scope: int = SCOPE) -> list[tuple[str, int, int]]:
    """The weak parts that stand with a complementary part in their scope."""
    weak = weak_parts(text, base)
    if not weak:
        return []
    parts = [(kind, s, e, kind) for kind, s, e in weak] + [(kind, s, e, _ROLES[kind]) for kind, s, e in base]
    cuts = [m.start() for m in _BLANK.finditer(text)]
    events = sorted([(e, 0, i) for i, (_, _, e, _) in enumerate(parts)] + [(s, 1, i) for i, (_, s, _, _) in enumerate(parts)])
    reach = dict.fromkeys(_COMPLEMENTS, -1)  # how far the parts of each role that have ended reach
    waiting: dict[str, list[tuple[int, int]]] = {role: [] for role in _COMPLEMENTS}  # ended and not linked yet: (until, part)
    kept = set()
    for at, starts, i in events:
        _, s, e, role = parts[i]
        if starts:
            for other in _COMPLEMENTS[role]:
                if reach[other] >= at:
                    kept.add(i)
                kept.update(k for until, k in waiting[other] if until >= at)
                waiting[other].clear()  # linked now, or out of reach for all that follow
        else:
            k = bisect_left(cuts, s)
            until = min(e + scope, cuts[k]) if k < len(cuts) else e + scope
            reach[role] = max(reach[role], until)
            waiting[role].append((until, i))
    return [parts[i][:3] for i in sorted(kept) if i < len(weak)]


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(set(spans), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def spans_of(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of a text, ordered by start, then kind."""
    base = base_spans(text or "")
    return _ordered(base), _ordered(base + linked_spans(text or "", base))


SPAN = "array<struct<kind:string,start:int,end:int,strong:boolean>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("strong", pa.bool_())]))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and spans (kind, start, end, strong) of every row."""
    rows = bound_batches(docs).select(*keep, text)

    def find(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = []
                for t in part.column(part.num_columns - 1).to_pylist():
                    base, every = spans_of(t)
                    strong = set(base)
                    found.append([{"kind": x[0], "start": x[1], "end": x[2], "strong": x in strong} for x in every])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, _SPAN)], [*part.schema.names[:-1], "spans"])

    return rows.mapInArrow(find, f"{docs.select(*keep).schema.simpleString()[7:-1]}, spans {SPAN}")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs, with every reported span of the text replaced by mark; overlapping spans are one."""
    at, columns = bound_batches(docs).columns.index(text), docs.columns

    def hide(value: str | None) -> str | None:
        if not value:
            return value
        out, last, until = [], 0, 0
        for kind, s, e in spans_of(value)[1]:
            if kind == "endpoint":
                continue
            if s >= until:
                out += [value[last:s], mark]
            until = last = max(until, e)
        return "".join([*out, value[last:]]) if out else value

    def work(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                cells = list(part.columns)
                cells[at] = pa.array([hide(t) for t in cells[at].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(cells, columns)

    return docs.mapInArrow(work, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """Per document the counts of base spans, the digest of their places and all spans as text."""
    place = lambda x: F.concat_ws(":", x.kind, x.start, x.end)
    count = lambda kind: F.size(F.filter("spans", lambda x: (x.kind == kind) & x.strong)).cast("long")
    return scan(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.array_join(F.transform(F.filter("spans", lambda x: x.strong), place), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", place), ",").alias("spans"),
        F.size(F.filter("spans", lambda x: ~x.strong)).cast("long").alias("n_linked"),
    )


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
