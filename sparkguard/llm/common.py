"""Shared helpers: durable intermediate tables, connected components, vectorised words of Arrow text columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches as bound_batches
from ..session import shared_dir, temporary

#: Text is worked on in slices of whole documents of about so many bytes, which bounds a Python worker's memory.
SLICE_BYTES = 1 << 20
_BLOCK = 1 << 18
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, so that a lost executor costs no recomputation of what is above.

    The table lasts as long as the application.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    temporary(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows up to which a table is broadcast.
BROADCAST_BYTES = 16 << 20


def sized(table: DataFrame, row_bytes: int | str = 16) -> DataFrame:
    """A written table, to be broadcast if it is small: by its rows of so many bytes, or by the lengths of a column."""
    size = F.count("*") * row_bytes if isinstance(row_bytes, int) else F.sum(F.octet_length(row_bytes))
    return F.broadcast(table) if (table.agg(size.alias("size")).first().size or 0) <= BROADCAST_BYTES else table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps, which need a number of rounds in the logarithm of the longest
    chain. Hot nodes only meet partial minima and joins that adaptive execution can split.
    """
    spark = edges.sparkSession
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = F.expr("struct(count(1) AS n, coalesce(bit_xor(xxhash64(u, v)), 0) AS x)")
    last = e.agg(mark.alias("m")).first().m
    while last.n:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("p"))
        e = materialize(small.select(F.col("p.v").alias("u"), F.col("p.m").alias("v")).filter("u <> v").distinct(), "edges")
        now = e.agg(mark.alias("m")).first().m
        if now == last:
            break
        last = now
    star = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).distinct() if last.n else spark.createDataFrame([], star.schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges [i, j) of whole rows with about limit bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: The ASCII white space that separates words.
SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and row of every word; words never cross rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separators[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts], after[cuts - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_MULT, _BLOCK), _powers(_INV, _BLOCK)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _range_hashes(values_of, n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each range of a sequence; starts and ends ascend. Blocks bound the memory."""
    at_start, at_end = np.zeros(len(starts), np.uint64), np.zeros(len(ends), np.uint64)
    total, up, down = np.uint64(0), 1, 1
    scale = np.empty(len(starts), np.uint64)
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values_of(lo, hi) * _UP[: hi - lo], out=run[1:])
        run = run * np.uint64(up) + total
        i, j = np.searchsorted(starts, [lo, hi])
        at_start[i:j] = run[starts[i:j] - lo]
        scale[i:j] = _DOWN[starts[i:j] - lo] * np.uint64(down)
        i, j = np.searchsorted(ends, [lo + 1, hi + 1])
        at_end[i:j] = run[ends[i:j] - lo]
        total = run[-1]
        up, down = up * pow(_MULT, hi - lo, 1 << 64) & _MASK, down * pow(_INV, hi - lo, 1 << 64) & _MASK
    return mix((at_end - at_start) * scale ^ (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    table = _BYTE[ASCII_LOWER] if lower else _BYTE
    return _range_hashes(lambda lo, hi: table[data[lo:hi]], len(data), starts, ends)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, as though all were one row; len(words) - k + 1 values."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return _range_hashes(lambda lo, hi: words[lo:hi], len(words), starts, starts + k)


def first_rows(counts: np.ndarray) -> np.ndarray:
    """Index of each row's first item where rows have counts items."""
    return np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
