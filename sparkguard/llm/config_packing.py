"""Best-fit packing by a configuration linear program over the histogram of piece lengths.

The histogram has at most `capacity` entries, whatever the corpus. Its configuration LP (as few configurations as
possible that cover every length's count) is solved by multiplicative weights: a length's weight is its size times the
exponential of its uncovered share, a knapsack dynamic program over all lengths prices the best configuration under the
weights, and a fraction of what it can cover is added to the solution. Each pricing also gives a dual bound on any
packing: the pieces' total weight over the best configuration's. Lengths of up to SMALL times the capacity stay out of the
LP, as they fill what is left; where more than CLASSES lengths remain, neighbours are solved as one class at its largest
length, and the room that a shorter piece leaves is filled too. Multiplicities are rounded, what is left over goes to the
tightest room (best fit decreasing on the histogram), and if that ever takes more sequences than best fit decreasing
alone, the latter's are taken. A table of rank ranges, bounded by (configurations x distinct lengths), places each piece.

Null text counts as empty: one piece that holds the end-of-document id. A text of any length is read whole and cut without
loss. Repeated rows are packed as often as they stand, null doc_ids are carried, and pieces that tie are placed in the
order of doc_id, piece and checksum. An empty table gives no pieces. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize
from .tokens import cut, documents_ids, public_path

CAPACITY = 4096
ROUNDS, CLASSES, SMALL, RATE = 500, 64, 1 / 16, 3.0


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""

    def tokenize(batches):
        for batch in batches:
            for first, ids, offsets in documents_ids(batch.column(1), path):
                raw = ids.astype("<u4").tobytes()
                rows = [(r, p, s, n, zlib.crc32(raw[4 * (o + s) : 4 * (o + s + n)])) for r, (o, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)) for p, (s, n) in enumerate(cut(e - o, capacity))]
                at, piece, start, length, crc = map(list, zip(*rows, strict=True))
                doc_id = batch.column(0).take(pa.array([first + r for r in at]))
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return bound_batches(docs).select("doc_id", "text").mapInArrow(tokenize, "doc_id long, piece int, start long, length long, ids_crc32 long")


Config = tuple[tuple[int, int], ...]


def price(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Unbounded knapsack over sizes (ascending): the greatest value within capacity, and how often it takes each size."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for room in range(int(sizes[0]), capacity + 1):
        with_it = best[room - sizes[: fits[room]]] + values[: fits[room]]
        k = int(with_it.argmax())
        best[room] = best[room - 1]
        if with_it[k] > best[room]:
            best[room], choice[room] = with_it[k], k
    room, chosen = capacity, Counter()
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            size = int(sizes[choice[room]])
            chosen[size] += 1
            room -= size
    return float(best[capacity]), dict(chosen)


def fractional(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[dict[Config, float], float]:
    """Configurations with fractional multiplicities that cover counts[length], and a bound below any such cover."""
    sizes = np.flatnonzero(counts)
    total = counts[sizes].astype(float)
    rest, solution, bound = total.copy(), Counter(), float(total @ sizes) / capacity
    step = float(np.clip(len(sizes) / (2 * rounds), 0.015, 0.5))
    for _ in range(rounds):
        open_ = np.flatnonzero(rest > 1e-6 * total)
        if rest @ sizes <= 1e-4 * (total @ sizes):
            break
        values = sizes[open_] * np.exp(RATE * rest[open_] / total[open_])
        best, config = price(sizes[open_], values, capacity)
        bound = max(bound, float(values @ total[open_]) / best)
        at, times = np.searchsorted(sizes, list(config)), np.array(list(config.values()))
        share = min((rest[at] / times).min(), step * (total[at] / times).min())
        solution[tuple(sorted(config.items()))] += share
        rest[at] = np.maximum(rest[at] - share * times, 0)
    return solution, bound


def _classes(counts: np.ndarray) -> np.ndarray:
    """Length to the largest length of its class, for at most CLASSES classes of about equally many tokens."""
    sizes = np.flatnonzero(counts)
    if len(sizes) > CLASSES:
        share = np.cumsum(counts[sizes] * sizes) / (counts[sizes] @ sizes)
        number = np.minimum((share * CLASSES).astype(int), CLASSES - 1)
        last = np.append(np.flatnonzero(np.diff(number)), len(sizes) - 1)
        top = sizes[last[np.searchsorted(last, np.arange(len(sizes)))]]
    else:
        top = sizes
    out = np.zeros(len(counts), np.int64)
    out[sizes] = top
    return out


class Packing:
    """Sequences as configurations with multiplicities, by the room that they leave."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[tuple[Counter, int]]] = [[] for _ in range(capacity + 1)]
        self.open = np.zeros(capacity + 1, bool)

    def add(self, config: Counter, copies: int) -> None:
        room = self.capacity - sum(size * n for size, n in config.items())
        self.by_room[room].append((config, copies))
        self.open[room] = True

    def fill(self, left: np.ndarray) -> None:
        """Best fit decreasing: the longest first, each into the tightest room that takes it, or into a new sequence."""
        for size in np.flatnonzero(left)[::-1].tolist():
            n = int(left[size])
            while n:
                step = int(self.open[size:].argmax()) if self.open[size:].any() else -1
                if step < 0:
                    room, (config, copies) = self.capacity, (Counter(), n)
                else:
                    room = size + step
                    config, copies = self.by_room[room].pop()
                    self.open[room] = bool(self.by_room[room])
                times = min(n, room // size)  # the room stays the tightest until it takes no more
                used = min(n // times, copies)
                if step >= 0 and copies > used:
                    self.add(config, copies - used)
                self.add(config + Counter({size: times}), used)
                n -= times * used

    def configurations(self) -> list[tuple[int, dict[int, int]]]:
        merged: Counter = Counter()
        for rows in self.by_room:
            for config, copies in rows:
                merged[tuple(sorted(config.items()))] += copies
        return [(copies, dict(config)) for config, copies in merged.items()]


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    packing = Packing(capacity)
    packing.fill(counts)
    return packing.configurations()


def _whole(solution: dict[Config, float], counts: np.ndarray) -> list[tuple[Config, int]]:
    """Multiplicities rounded down; then one more of those with the largest remainders, while their pieces last."""
    left, out = counts.copy(), Counter()
    for config, x in sorted(solution.items(), key=lambda i: (-i[1], i[0])):
        n = int(min(np.floor(x + 1e-9), *(left[s] // k for s, k in config)))
        out[config] += n
        for s, k in config:
            left[s] -= n * k
    for config, x in sorted(solution.items(), key=lambda i: (-(i[1] % 1), i[0])):
        if x % 1 >= 0.3 and all(left[s] >= k for s, k in config):
            out[config] += 1
            for s, k in config:
                left[s] -= k
    return [(config, n) for config, n in out.items() if n]


def solve(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[int, dict[int, int]]], float]:
    """(multiplicity, {length: times}) of configurations that pack counts[length] pieces of each length exactly, and a bound on any packing."""
    counts = counts.astype(np.int64)
    sizes = np.arange(capacity + 1)
    bound = float(counts @ sizes) / capacity
    large = np.where((sizes > SMALL * capacity) & (sizes < capacity), counts, 0)
    packing = Packing(capacity)
    left = counts.copy()
    if large.any():
        top = _classes(large)
        grouped = np.bincount(top, large, minlength=capacity + 1).astype(np.int64)
        solution, dual = fractional(grouped, capacity, rounds)
        if (grouped == large).all():  # the bound of rounded-up lengths isn't one for the lengths themselves
            bound = max(bound, dual + counts[capacity])
        waiting = {int(t): [int(s) for s in np.flatnonzero((top == t) & (large > 0))] for t in np.flatnonzero(grouped)}
        for config, n in _whole(solution, grouped):
            while n:  # as many copies as the longest waiting pieces of each class allow
                own: Counter = Counter()
                for t, k in config:
                    for s in reversed(waiting[t]):
                        own[s] += min(k, int(left[s]))
                        k -= min(k, int(left[s]))
                        if not k:
                            break
                copies = min(n, *(int(left[s] // k) for s, k in own.items()))
                packing.add(own, copies)
                n -= copies
                for s, k in own.items():
                    left[s] -= copies * k
                    if not left[s]:
                        waiting[int(top[s])].remove(s)
    packing.fill(left)
    found, plain = packing.configurations(), best_fit(counts, capacity)
    return min(found, plain, key=lambda x: sum(n for n, _ in x)), bound


def places(configurations: list[tuple[int, dict[int, int]]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Ranges of the ranks of each length, sorted: key = length and first rank, with the sequence and offset they go to."""
    taken, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for copies, config in configurations:
        offset = 0
        for length, times in sorted(config.items(), reverse=True):
            rows.append((length, taken[length], times, sequence, offset))
            taken[length] += copies * times
            offset += length * times
        sequence += copies
    rows.sort()
    names = ("length", "rank", "times", "sequence", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def ranked(rows: DataFrame, chunks: int) -> DataFrame:
    """rows with rank: 0, 1, ... within each length; a frequent length is numbered in chunks."""
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    sizes = rows.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = sizes.select("length", "chunk", (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32"))
    return rows.withColumn("inner", inner).join(before, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("inner") - 1).drop("chunk", "inner", "before")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    rows = materialize(pieces(docs, path or public_path(), capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():  # at most capacity rows
        counts[length] = n
    shared = spark.sparkContext.broadcast(places(solve(counts, capacity)[0], capacity))

    def place(batches):
        at = shared.value
        key = (at["length"] << 45) + at["rank"]
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            k = np.searchsorted(key, (length << 45) + rank, "right") - 1
            inner = rank - at["rank"][k]
            sequence = at["sequence"][k] + inner // at["times"][k]
            offset = at["offset"][k] + inner % at["times"][k] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = ranked(rows, chunks).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return found.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
