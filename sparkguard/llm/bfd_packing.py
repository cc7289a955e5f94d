"""Packed token-id rows by best-fit decreasing with a segment-tree capacity search.

Documents are tokenized, closed with the end-of-document id, and cut losslessly into pieces of at most `capacity` ids.
Each task packs the pieces of its input split in blocks of BLOCK_TOKENS ids: longest first, each into the open row with
the smallest sufficient room, found in a segment tree over room sizes. Nothing is shuffled, memory is bounded by the
block, and a block leaves at most a few rows part filled. A row is written as its id vector (little-endian 32 bit, short of `capacity`
only by its padding), the cumulative lengths of its segments, and position ids that restart at every segment.

Null text counts as empty: one piece that holds the end-of-document id alone. A text of any length is read whole. Repeated rows
are packed as often as they stand. Null doc_ids are carried. Ties: of equally long pieces the earlier one is placed first. An empty
table gives no rows. Other columns, whatever their names, are not read. sequence_id = partition * 2**32 + number in the partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .tokens import cut, documents_ids, public_path

CAPACITY = 4096
BLOCK_TOKENS = 8 << 20


class RoomTree:
    """Counts of open rows by room; leaves are rooms 0..capacity of a complete binary tree."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def _add(self, room: int, n: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += n
            i //= 2

    def put(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, row) with the smallest room of at least least."""
        i = self.leaves + least
        if not self.count[i]:
            while i & 1 or not self.count[i + 1]:  # climb until a right sibling holds a row
                i //= 2
                if not i:
                    return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Rows of indices into lengths; ties go to the earlier piece."""
    tree, rows = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        room, row = found or (capacity, len(rows))
        if not found:
            rows.append([])
        rows[row].append(i)
        tree.put(room - lengths[i], row)
    return rows


SCHEMA = "sequence_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, segments array<struct<doc_id:long,piece:int,start:long,length:int>>"


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per packed sequence: ids, cumulative segment lengths (from 0), and the segments in order."""
    path = path or public_path()
    segment = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32())]))

    def flush(parts, first):
        """parts: (doc_id, piece, start, ids)."""
        rows = best_fit_decreasing([len(p[3]) for p in parts], capacity)
        for i in range(0, len(rows), 256):
            some = rows[i : i + 256]
            ids = [np.concatenate([parts[k][3] for k in row]) for row in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(first + i, first + i + len(some)), pa.int64()),
                    pa.array([len(x) for x in ids], pa.int32()),
                    pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                    pa.array([np.concatenate(([0], np.cumsum([len(parts[k][3]) for k in row]))).tolist() for row in some], pa.list_(pa.int32())),
                    pa.array([[{"doc_id": parts[k][0], "piece": parts[k][1], "start": parts[k][2], "length": len(parts[k][3])} for k in row] for row in some], segment),
                ],
                ["sequence_id", "n_tokens", "input_ids", "cu_seqlens", "segments"],
            )

    def work(batches):
        context = TaskContext.get()
        first = context.partitionId() << 32
        parts, held = [], 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, ids, offsets in documents_ids(batch.column(1), path):
                for r in range(len(offsets) - 1):
                    row = ids[offsets[r] : offsets[r + 1]]
                    parts += [(doc_ids[at + r], p, s, row[s : s + n]) for p, (s, n) in enumerate(cut(len(row), capacity))]
                    held += len(row)
                if held >= block_tokens:
                    for out in flush(parts, first):
                        first += out.num_rows
                        yield out
                    parts, held = [], 0
        if parts:
            yield from flush(parts, first)

    return bound_batches(docs).select("doc_id", "text").mapInArrow(work, SCHEMA)


def with_positions(packed: DataFrame) -> DataFrame:
    """packed with position_ids, which restart at 0 in every segment."""
    return packed.withColumn("position_ids", F.flatten(F.transform("segments", lambda s: F.sequence(F.lit(0), s.length - 1))))


def write_packed(packed: DataFrame, path: str, capacity: int = CAPACITY, pad_id: int = 0) -> None:
    """Write fixed-width rows (an id matrix, padded), cumulative lengths and position resets as Parquet."""
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), F.lit(capacity) - F.col("n_tokens")))
    ids = F.concat("input_ids", pad)
    resets = F.slice("cu_seqlens", F.lit(1), F.size("cu_seqlens") - 1)
    packed.select("sequence_id", "n_tokens", ids.alias("input_ids"), "cu_seqlens", resets.alias("position_resets"), "segments").write.parquet(path)


def digest(written: DataFrame) -> DataFrame:
    """Rows of the written matrix with the checksum of their ids, short of the padding."""
    ids = F.expr("substring(input_ids, 1, 4 * n_tokens)")
    return written.select("sequence_id", "n_tokens", F.crc32(ids).alias("ids_crc32"), "input_ids", "cu_seqlens", "position_resets", "segments")
