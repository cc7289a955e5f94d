"""WARC archives: write pages as records, and read archives back with salvage of damaged files.

Writing: of pages with equal payloads of at least REVISIT_BYTES bytes (by SHA-1 and length) the one with the largest
page_id is a `response`; the others are `revisit` records that refer to it. Smaller payloads are all responses. Records
are framed by their Content-Length and written through Spark's text writer, whose line separator is the blank lines that end a
WARC record, so archives can be in any store that Spark reaches.

Reading: a record is accepted if its version line, headers, length, end and payload digest (SHA-1 in hex or base32) hold;
plain files and files of gzip members, of one record or of many, are both read. After a failed check the reader searches for
the next valid member or version line, goes on from there, and logs the bytes between as a quarantined gap. It does the same
within the bytes of a member, and within what inflates of one that is damaged or cut off; its records and gaps have the
member's place in the file. In a member that fails to inflate or its own checksum, records without a digest that can be
checked are `unverified`. A file is held in memory by one task, and so is what a member inflates to: archives written here
are bounded by bytes, those of others by what a row of Spark's binaryFile source holds (2 GiB).

Null html counts as an empty payload, a null url as no target. A null page_id is carried as such. Repeated rows are
written once each; rows that tie for the largest page_id are all responses. Very long payloads are written and read whole. An
empty table gives an archive without records, and no rows. Columns beside page_id, url and html, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, materialize, shared_dir, slices

REVISIT_BYTES = 1000
#: Records are written in blocks of about so many bytes, so many to a file; a file is read by one task. It holds at most
#: FILE_BLOCKS * BLOCK_BYTES bytes, or FILE_BLOCKS records where single ones are longer than a block.
BLOCK_BYTES, FILE_BLOCKS = 4 << 20, 8
#: Repeated payloads (some 80 bytes each) up to which their table is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_START = re.compile(rb"(?:(?<=\n)|\A)WARC/1\.[01]\r?\n|\x1f\x8b\x08")
_LINE = re.compile(rb"(?<=\n)WARC/1\.[01]\r?\n")
_TEXT = re.compile(rb"\S")
_CHUNK = 1 << 16
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def records(pages: DataFrame) -> DataFrame:
    """page_id and the text of each page's record, without the blank lines that end it."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload")).withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    copies = pages.select("page_id", F.coalesce("html", F.lit("")).alias("payload")).select("page_id", F.octet_length("payload").alias("n"), F.sha1(F.encode("payload", "UTF-8")).alias("digest"))
    holders = copies.filter(F.col("n") >= REVISIT_BYTES).groupBy("digest", "n").agg(F.max("page_id").alias("holder"), F.count("*").alias("c")).filter("c > 1 AND holder IS NOT NULL")
    holders = materialize(holders.drop("c"), "holders")
    # payloads are shuffled only where the table of repeated ones is too large to broadcast
    small = holders.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(holders) if small else holders, ["digest", "n"], "left")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n"))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(_HTTP), F.col("n").cast("string"), F.lit("\r\n\r\n"), "payload"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    uri = F.regexp_replace("url", r"[\r\n]", "%0A")
    text = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page_id")),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("digest")),
        line("X-Payload-Length", F.col("n").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", name("holder")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        "block",
    )
    return rows.withColumn("block", block).select("page_id", text.alias("value"))


def _blocks(block_bytes: int):
    """Records to blocks of consecutive ones, with the blank lines that end each but the last."""

    def work(batches):
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column(0)), dtype=np.int64)
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            joined = []
            for i, j in slices(cuts, block_bytes):
                joined.append("\r\n\r\n".join(batch.column(0).slice(i, j - i).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(joined, pa.string())], ["value"])

    return work


def write_archives(pages: DataFrame, path: str, block_bytes: int = BLOCK_BYTES, file_blocks: int = FILE_BLOCKS) -> None:
    blocks = bound_batches(records(pages)).select("value").mapInArrow(_blocks(block_bytes), "value string")
    blocks.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_blocks).text(path)


def _headers(raw: bytes) -> dict[str, str]:
    """Header lines end at CR LF or LF only: other line ends of Unicode may stand within a value."""
    out = {}
    for row in raw.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        key, colon, value = row.partition(":")
        if colon:
            out[key.strip().lower()] = value.strip()
    return out


def _sha1_hex(digest: str) -> str | None:
    """A declared SHA-1 as lower-case hex, or null if it is none: hex and base32, upper and lower case."""
    kind, _, value = digest.partition(":")
    if kind.strip().lower() != "sha1":
        return None
    value = value.strip()
    if re.fullmatch("[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else None


def _unchunked(body: bytes) -> bytes | None:
    """The content of a body in chunked transfer coding, or null if it isn't such a body."""
    out, at = [], 0
    while size := re.compile(rb"([0-9a-fA-F]{1,8})[ \t]*(?:;[^\r\n]*)?\r\n").match(body, at):
        n = int(size[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[size.end() : size.end() + n])
        at = size.end() + n + 2
    return None


def _digest_holds(payload: bytes, want: str) -> bool:
    """Writers take the digest of a chunked payload as it is or of its content."""
    if hashlib.sha1(payload).hexdigest() == want:
        return True
    plain = _unchunked(payload)
    return plain is not None and hashlib.sha1(plain).hexdigest() == want


def parse_record(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record at a place and the place after it, or why there is none."""
    if not _VERSION.match(data, at):
        return "no version line"
    gap = b"\r\n\r\n" if data[at + 8 : at + 10] == b"\r\n" else b"\n\n"
    end = data.find(gap, at)
    if end < 0:
        return "headers do not end"
    head = _headers(data[at:end])
    if not head.get("content-length", "").isdigit() or "warc-type" not in head:
        return "bad headers"
    start = end + len(gap)
    stop = start + int(head["content-length"])
    if stop > len(data):
        return "block is cut off"
    if data[stop : stop + len(gap)] != gap and _TEXT.search(data, stop):
        return "record does not end"
    block = data[start:stop]
    http = block.startswith(b"HTTP/") or head.get("content-type", "").lower().startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    want = None if head["warc-type"] == "revisit" else _sha1_hex(head.get("warc-payload-digest", ""))
    if want and not _digest_holds(payload, want):
        return "payload digest differs"
    return {"headers": head, "payload": payload, "offset": at, "checked": want is not None}, min(len(data), stop + len(gap))


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What inflates of the member at a place, the place where that ends, and why it ends before the member does."""
    view, inflate, out, place = memoryview(data), zlib.decompressobj(31), [], at
    step = 1 << 12  # small members are given small pieces, as what follows one is copied with it
    while place < len(data) and not inflate.eof:
        before = inflate.copy()
        try:
            out.append(inflate.decompress(view[place : place + step]))
        except zlib.error as e:
            # what the bytes before the error give is lost with the call that fails, so the piece is halved down to the bad byte
            while step > 1:
                step //= 2
                trial = before.copy()
                try:
                    out.append(trial.decompress(view[place : place + step]))
                except zlib.error:
                    continue
                before, place = trial, place + step
            return b"".join(out), place, f"bad member: {e}"
        place = min(len(data), place + step)
        step = min(2 * step, _CHUNK)
    return b"".join(out), place - len(inflate.unused_data), "" if inflate.eof else "member is cut off"


def _inner(data: bytes, error: str):
    """Records and gaps of a member's bytes, as salvage() gives those of a file."""
    at, bad, why = 0, None, ""
    while at < len(data):
        got = parse_record(data, at)
        if not isinstance(got, str):
            if bad is not None:
                yield "gap", f"{why} (bytes {bad} to {at} of the member)"
                bad = None
            yield "record" if got[0]["checked"] or not error.startswith("bad") else "unverified", got[0]
            at = got[1]
            continue
        if bad is None:
            bad, why = at, got
        step = _LINE.search(data, at + 1)
        at = step.start() if step else len(data)
    if bad is not None:
        yield "gap", f"{why} (bytes {bad} to {len(data)} of the member)"
    if error:
        yield "gap", error


def salvage(data: bytes):
    """Yields ("record", record, start, end), ("unverified", record, start, end) and ("gap", reason, start, end), which together cover the file."""
    at, bad, why = 0, None, ""
    held: list[tuple] = []  # of a damaged member, whose end is where the next valid one begins
    held_at = inflated = 0
    while at < len(data):
        found: list[tuple] = []
        error = ""
        if data.startswith(b"\x1f\x8b", at):
            out, after, error = _member(data, at)
            found = list(_inner(out, error))
            valid = any(kind != "gap" for kind, _ in found)
            reason = "" if valid or not found else error or found[0][1]
        else:
            got = parse_record(data, at)
            reason, after = (got, at) if isinstance(got, str) else ("", got[1])
            found = [] if reason else [("record", got[0])]
        if not reason:
            yield from ((kind, what, held_at, at) for kind, what in held)
            held = []
            if bad is not None:
                yield "gap", why, bad, at
                bad = None
            if not error:
                yield from ((kind, what, at, after) for kind, what in found)
                at = after
                continue
            held, held_at, inflated = found, at, after
        elif bad is None and not held:
            bad, why = at, reason
        # members may begin in what a damaged one took for its own; version lines there have been seen
        step = _START.search(data, at + 1)
        while step and step.start() < inflated and step[0][:1] == b"W":
            step = _START.search(data, step.end())
        at = step.start() if step else len(data)
    yield from ((kind, what, held_at, len(data)) for kind, what in held)
    if bad is not None:
        yield "gap", why, bad, len(data)


READ = "file string, kind string, start long, end long, reason string, record_id string, record_type string, target_uri string, refers_to string, declared_digest string, declared_length long, payload binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record (or unverified record) and one per quarantined gap of every file below path."""
    files = bound_batches(spark.read.format("binaryFile").load(path)).select("path", "content")

    def work(batches):
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        types = [kinds[x.split()[1]] for x in READ.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                file, data, rows = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), []
                for kind, what, start, end in salvage(data):
                    if kind == "gap":
                        rows.append((file, kind, start, end, what, *[None] * 7))
                    else:
                        h = what["headers"]
                        length = h.get("x-payload-length", "")
                        rows.append((file, kind, start, end, None if kind == "record" else "no digest to check in a damaged member", h.get("warc-record-id"), h["warc-type"], h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), int(length) if length.isdigit() else None, what["payload"]))
                    if len(rows) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.mapInArrow(work, READ)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages' archives below path, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    write_archives(pages, path)
    found = read_archives(spark, path).filter("kind = 'record'")
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) AS bigint)")
    revisit = F.col("record_type") == "revisit"
    return found.select(
        page("record_id").alias("page_id"),
        F.when(revisit, F.col("declared_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("declared_digest", "^sha1:", "")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        F.when(revisit, page("refers_to")).alias("refers_to"),
    )


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
h AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS holder FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN holder IS NOT NULL AND page_id IS DISTINCT FROM holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to FROM h"""
