"""Near-duplicate embeddings by p-stable (Gaussian) Euclidean hashing, then exact cosines.

Vectors are normalised and hashed in several tables by quantised random projections of width WIDTH; vectors of one label
and dimension that share a key are compared exactly, in double precision. At a cosine of 0.98 (distance 0.2) one projection
agrees with a probability of 0.90, for unrelated vectors (distance 1.4) with 0.41. As in the theory of such hashing, the number of
projections of a table follows the logarithm of the largest label's number of vectors, so that an unrelated row meets
about one other in a table whatever the size, and there are as many tables as bring the chance of missing a pair at the
threshold below MISS (closer pairs are missed less). Equal vectors are one node with a multiplicity. Buckets with the same members
are one; a bucket is compared in pairs of blocks, each pair of vectors counts in the first table that they share, and
tasks return sums and local star edges, never pairs.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or vec_id, link with
nothing: n_links 0, component_id = vec_id, kept. Repeated rows count as further copies, and so do rows that share a vec_id with
other vectors; each keeps its own links. Vectors of different lengths never link; long ones are hashed and compared whole. Ties:
the smallest vec_id names a component. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, connected_components, materialize, mix

COSINE, WIDTH, BLOCK = 0.98, 1.6, 512
#: Probability at most with which a pair at the threshold is missed, and projections of a table at least.
MISS, LEAST_PROJECTIONS = 1e-4, 8


def agreement(distance: float, width: float = WIDTH) -> float:
    """Probability with which one quantised projection of two vectors at this distance agrees."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def parameters(vectors: int, cosine: float = COSINE) -> tuple[int, int]:
    """(tables, projections) for labels of at most so many vectors."""
    near, far = agreement(math.sqrt(2 - 2 * min(cosine, 0.9999))), agreement(math.sqrt(2))
    projections = max(LEAST_PROJECTIONS, math.ceil(math.log(max(vectors, 1)) / -math.log(far)))
    return math.ceil(math.log(MISS) / math.log(1 - near**projections)), projections


def _projections(dimension: int, tables: int, projections: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng([7, dimension])
    return draw.standard_normal((dimension, tables * projections)), draw.random(tables * projections)


def table_keys(vectors: np.ndarray, tables: int, projections: int, width: float = WIDTH) -> np.ndarray:
    """keys[vector, table] of rows of finite, non-zero vectors."""
    directions, shift = _projections(vectors.shape[1], tables, projections)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cells = np.floor(unit @ directions / width + shift).astype(np.int64).view(np.uint64).reshape(len(vectors), tables, projections)
    key = np.zeros((len(vectors), tables), np.uint64)
    for p in range(projections):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, p])
    return key


def _hashed(vectors: DataFrame, tables: int, projections: int) -> DataFrame:
    """(node, label, embedding, copies) to the same with norm-independent keys."""

    def work(batches):
        for batch in batches:
            rows = batch.column(2).to_pylist()
            keys = np.zeros((len(rows), tables), np.uint64)
            sizes = np.array([len(r) for r in rows])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                keys[at] = table_keys(np.array([rows[i] for i in at], np.float64), tables, projections)
            cuts = np.arange(0, len(rows) * tables + 1, tables, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys.reshape(-1).view(np.int64)))], [*batch.schema.names, "keys"])

    return vectors.mapInArrow(work, f"{vectors.schema.simpleString()[7:-1]}, keys array<bigint>")


def _compare(cosine: float):
    """Groups of (group, t, side, node, copies, embedding, keys), sorted by group, to (node, n, root): links counted here, and a node it is joined to."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        t, side, node, copies = (np.array([r[i] for r in rows]) for i in (1, 2, 3, 4))
        x, keys = np.array([r[5] for r in rows], np.float64), np.array([r[6] for r in rows])
        norm = np.linalg.norm(x, axis=1)
        linked = x @ x.T / np.outer(norm, norm) >= cosine
        np.fill_diagonal(linked, False)
        if side.min() != side.max():
            linked &= side[:, None] != side
        new = linked.copy()
        for s in range(t[0]):
            new &= keys[:, s][:, None] != keys[:, s]
        order = np.argsort(node)
        rank = np.empty(len(node), np.int64)
        rank[order] = np.arange(len(node))
        while True:
            low = np.minimum(rank, np.where(linked, rank, len(node)).min(1))
            if (low == rank).all():
                break
            rank = low
        n, root = new @ copies, node[order[rank]]
        some = (n > 0) | (root != node)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(n[some].astype(np.int64)), pa.array(root[some])], ["node", "n", "root"])

    def work(batches):
        group, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != group:
                    if len(rows) > 1:
                        yield solve(rows)
                    group, rows = row[0], []
                rows.append(row)
        if len(rows) > 1:
            yield solve(rows)

    return work


def _buckets(members: DataFrame) -> DataFrame:
    """Buckets of several members; of those with the same members only the first table's."""
    mark = [F.count("*").alias("n"), F.min("t").alias("t"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 40))).alias("s")]
    return members.groupBy("bucket").agg(*mark).filter("n > 1").groupBy("n", "x", "s").agg(F.min_by("bucket", "t").alias("bucket"), F.min("t").alias("t"))


def candidate_buckets(hashed: DataFrame) -> DataFrame:
    """(bucket, t, node, n) of every vector in every bucket that is compared."""
    members = hashed.select("node", "label", F.size("embedding").alias("d"), F.posexplode("keys").alias("t", "key")).select(F.xxhash64("label", "d", "t", "key").alias("bucket"), "t", "node")
    return members.join(_buckets(members).select("bucket", "n"), "bucket")


def near_duplicate_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    key = [F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit(1), "label", "embedding").alias("k2")]
    rows = bound_batches(embeddings).select("vec_id", "label", "embedding")
    fine = F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(embedding, x -> x <> 0)")
    valid = rows.filter(F.coalesce(fine, F.lit(False)))
    grouped = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    nodes = materialize(grouped.select(F.monotonically_increasing_id().alias("node"), "label", "embedding", "low", "copies", *key), "vectors")
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    tables, projections = parameters(largest, cosine)
    hashed = materialize(_hashed(nodes.select("node", "label", "embedding", "copies"), tables, projections), "hashed")
    placed = candidate_buckets(hashed).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("side", F.pmod(F.hash("node"), F.col("blocks")))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other"))
    groups = paired.select(group.alias("group"), "t", "side", "node").join(hashed.select("node", "copies", "embedding", "keys"), "node")
    compared = groups.select("group", "t", "side", "node", "copies", "embedding", "keys").repartition("group").sortWithinPartitions("group").mapInArrow(_compare(cosine), "node long, n long, root long")
    compared = materialize(compared, "compared")
    counts = compared.groupBy("node").agg(F.sum("n").alias("n"))
    comps = materialize(connected_components(compared.select(F.col("node").alias("a"), F.col("root").alias("b"))), "components")
    ids = nodes.select("node", "low").join(comps, "node")
    smallest = ids.groupBy("component").agg(F.min("low").alias("component_id"))
    named = ids.select("node", "component").join(smallest, "component").select("node", "component_id")
    found = nodes.select("node", "low", "copies", "k1", "k2").join(counts, "node", "left").join(named, "node", "left")
    found = found.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "low").alias("component_id"))
    linked = valid.select("vec_id", *key).join(found, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS norm FROM v WHERE list_inner_product(x, x) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_inner_product(a.x, b.x) / (a.norm * b.norm) >= {COSINE}),
r AS (SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node WHERE r.low < l.b),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(c.low, vec_id) AS component_id, vec_id = least(c.low, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id"""
