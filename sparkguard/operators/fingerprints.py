"""Fingerprints of tables as trees of hashes over ranges of keys, kept in bounded state: which rows differ is found by descending two trees.

A row's hash is the SHA-256 of its columns. Ranges are those of the keys' hashes, 16 below each node, so that they are of like size whatever the keys are.
A node holds the number of its rows and the sums of their hashes, in four lanes of 60 bits: sums of ranges are sums of their parts, so partial
aggregation does the work, in any order. A node's digest is the SHA-256 of its number and lanes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a leaf, about, where no depth is given.
LEAF_ROWS = 256
#: Hexadecimal digits of a lane.
DIGITS = 15
LANES = [f"lane{i}" for i in range(4)]


def row_hash(columns: list[str]) -> Column:
    """Each value as `-` for null, else its number of bytes, `:` and its text, in the order of the columns' names."""
    text = [F.col(c).cast("string") for c in sorted(columns)]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _digest() -> Column:
    return F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *[F.col(n).cast("string") for n in LANES]), 256).alias("digest")


def depth_for(rows: int) -> int:
    depth = 0
    while LEAF_ROWS * 16**depth < rows:
        depth += 1
    return depth


def _range(key: str, depth: int) -> Column:
    return F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256), 1, depth)


def fingerprint_tree(documents: DataFrame, key: str = "document_id", depth: int | None = None) -> DataFrame:
    """level, range, rows, digest of every node that has rows; level 0 is the root, which an empty table lacks. Trees are compared at equal depth."""
    if depth is None:
        depth = depth_for(documents.count())
    h = documents.select(_range(key, depth).alias("range"), row_hash(documents.columns).alias("h"))
    lane = lambda i: F.conv(F.substring("h", i * DIGITS + 1, DIGITS), 16, 10).cast("decimal(38,0)").alias(LANES[i])
    totals = [F.sum("rows").alias("rows"), *[F.sum(n).cast("decimal(38,0)").alias(n) for n in LANES]]
    leaves = h.select("range", F.lit(1).cast("long").alias("rows"), *map(lane, range(4))).groupBy("range").agg(*totals)
    each = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "range", "rows", *LANES)
    nodes = each.groupBy("level", F.expr("substring(range, 1, level)").alias("range")).agg(*totals)
    return nodes.select("level", "range", "rows", _digest())


def source_fingerprint(documents: DataFrame, key: str = "document_id") -> DataFrame:
    """One row: the digest of the root; the depth of a tree doesn't change it."""
    return fingerprint_tree(documents, key, 0).select(F.col("digest").alias("fingerprint"))


def changed_ranges(before: DataFrame, after: DataFrame, depth: int) -> DataFrame:
    """The leaf ranges in which two trees differ, level by level below nodes that do; equal subtrees aren't looked into."""
    found = None
    for level in range(depth + 1):
        a = before.filter(F.col("level") == level).select("range", F.col("digest").alias("before"))
        b = after.filter(F.col("level") == level).select("range", F.col("digest").alias("after"))
        if found is not None:
            above = found.select(F.col("range").alias("above"))
            inside = lambda t: t.withColumn("above", F.substring("range", 1, level - 1)).join(above, "above", "left_semi").drop("above")  # noqa: B023, E731
            a, b = inside(a), inside(b)
        found = a.join(b, "range", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after"))).select("range")
    return found


def changed_rows(before: DataFrame, after: DataFrame, ranges: DataFrame, depth: int, key: str = "document_id") -> DataFrame:
    """key and state (missing, new, changed) of the rows that differ, of which only those in the ranges are compared."""
    mine = lambda t, name: t.withColumn("range", _range(key, depth)).join(ranges, "range", "left_semi").groupBy(key).agg(F.sum(F.conv(F.substring(row_hash(t.columns), 1, DIGITS), 16, 10).cast("decimal(38,0)")).alias(name))
    a, b = mine(before, "a"), mine(after, "b")
    joined = a.withColumnRenamed(key, "ka").join(b.withColumnRenamed(key, "kb"), F.col("ka").eqNullSafe(F.col("kb")), "full_outer")
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "changed")
    return joined.select(F.coalesce("ka", "kb").alias(key), state.alias("state")).filter("state IS NOT NULL")
