"""Merkle manifest of a dataset, with a version of the tree for each tampered row.

Every row is a leaf, the digest of its fields. Leaves of a partition value (lang) ascend by doc_id; every ARITY consecutive
nodes become their digest until one is left, and the partitions' roots are joined likewise into the root of the dataset.

Leaves are numbered by a range shuffle and the counts of its partitions, and cut into aligned blocks of ARITY ** LEVELS.
A task holds one block at a time as a persistent tree: a tampered leaf makes a new version that copies the leaf's ancestors and
shares every other node of the store. Block roots are the leaves of the next, distributed level, which is built in the same way
until each partition has one node. Each block then gets the path from its root to that of the dataset, so that its versions go on
through the upper levels where the block lies, and no task holds more than a block.

H is the lower-case hexadecimal SHA-256 of its inputs, concatenated, with digests as text. A leaf is H of doc_id, source, lang, n_chars and
text, each `-` where null, else its number of UTF-8 bytes, `:` and the value. Rows with a null doc_id come first in their partition and are
never tampered; a null lang is a partition of its own, the first. Rows that share a doc_id are ordered by their leaves, so that repeated rows are
leaves beside each other. Empty and very long texts are hashed whole. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bound_batches, materialize, sized

ARITY, LEVELS = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
SIDES = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
#: Rows of a batch of proofs, which take about 3 kB each.
PROOFS = 512


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The leaf of a documents row with this text."""
    return F.sha2(F.concat(*(encoded(text if name == "text" else F.col(name)) for name in FIELDS)), 256)


def lowered(text: str = "text") -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def levels_of(total: int) -> int:
    """Levels above total nodes until one is left."""
    n = 0
    while total > 1:
        total, n = -(-total // ARITY), n + 1
    return n


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with `position` from 0 within their key, in this order, and the key's `total`; equal rows may take either's place."""
    place = F.expr("monotonically_increasing_id() AS row")
    ordered = rows.withColumn("tie", F.monotonically_increasing_id())
    by = [F.asc_nulls_first(c) for c in (key, *order, "tie")]
    written = materialize(ordered.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").select("*", place), "ordered")
    part = F.shiftright("row", 33)
    runs = written.groupBy(key, part.alias("part")).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    of_key = Window.partitionBy(key)
    before = F.coalesce(F.sum("n").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col(key).alias("run_key"), F.col("part").alias("run_part"), (before - F.col("first")).alias("shift"), F.sum("n").over(of_key).alias("total"))
    joined = written.join(sized(materialize(runs, "runs"), 48), F.col(key).eqNullSafe(F.col("run_key")) & (part == F.col("run_part")))
    return joined.select(*rows.columns, (F.col("row") + F.col("shift")).alias("position"), "total")


@dataclass
class PersistentTree:
    """A store of nodes in which versions share what they have in common; a node is its digest and the places of its children."""

    digests: list[bytes] = field(default_factory=list)
    children: list[tuple[int, ...]] = field(default_factory=list)
    root: int = 0

    def add(self, digest: bytes, children: tuple[int, ...] = ()) -> int:
        self.digests.append(digest)
        self.children.append(children)
        return len(self.digests) - 1

    def join(self, children: tuple[int, ...]) -> int:
        return self.add(hashlib.sha256(b"".join([self.digests[c] for c in children])).hexdigest().encode(), children)

    @classmethod
    def build(cls, leaves: list[bytes], levels: int) -> PersistentTree:
        tree = cls()
        nodes = [tree.add(x) for x in leaves]
        for _ in range(levels):
            nodes = [tree.join(tuple(nodes[i : i + ARITY])) for i in range(0, len(nodes), ARITY)]
        (tree.root,) = nodes
        return tree

    def descent(self, i: int, levels: int) -> list[tuple[int, int]]:
        """(node, which of its children) from the root down to leaf i."""
        out, node = [], self.root
        for level in range(levels - 1, -1, -1):
            at = i // ARITY**level % ARITY
            out.append((node, at))
            node = self.children[node][at]
        return out

    def path(self, i: int, levels: int) -> list[tuple[bytes, bytes]]:
        """The siblings to the left and to the right, from leaf i up."""
        beside = lambda nodes: b"".join([self.digests[c] for c in nodes])
        return [(beside(self.children[node][:at]), beside(self.children[node][at + 1 :])) for node, at in reversed(self.descent(i, levels))]

    def version(self, i: int, digest: bytes, levels: int) -> int:
        """The root of a version with another leaf i: only its ancestors are copied."""
        new = self.add(digest)
        for node, at in reversed(self.descent(i, levels)):
            old = self.children[node]
            new = self.join((*old[:at], new, *old[at + 1 :]))
        return new


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        digest = hashlib.sha256(left + digest + right).hexdigest().encode()
    return digest


def _blocks(nodes: DataFrame, columns: list[str], levels: int) -> DataFrame:
    """One row for each aligned block of numbered nodes, with the block's nodes in order; a block has a bounded number of them."""
    block = F.expr(f"position div {ARITY**levels} AS block")
    listed = F.array_sort(F.collect_list(F.struct("position", *columns)))
    return materialize(nodes.groupBy("key", block).agg(F.first("total").alias("total"), listed.alias("nodes")), "blocks")


def _rows(batches, *names: str) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):  # one block's objects at a time
            yield tuple(batch.column(n)[i].as_py() for n in names)


def _tree(nodes: list[dict], total: int, most: int) -> tuple[PersistentTree, int]:
    levels = min(most, levels_of(total))
    return PersistentTree.build([n["digest"].encode() for n in nodes], levels), levels


def _pairs(path: list[tuple[bytes, bytes]]) -> list[dict]:
    return [{"left": a.decode(), "right": b.decode()} for a, b in path]


def _roots(blocks: DataFrame, most: int) -> DataFrame:
    """The root of each block, a node of the next level."""

    def work(batches):
        for key, block, total, nodes in _rows(batches, "key", "block", "total", "nodes"):
            tree, _ = _tree(nodes, total, most)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([block]), pa.array([-(-total // ARITY**most)]), pa.array([tree.digests[tree.root].decode()])], ["key", "position", "total", "digest"])

    return bound_batches(blocks).mapInArrow(work, "key string, position long, total long, digest string")


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    paths = paths.select(F.col("key").alias("path_key"), F.col("block").alias("path_block"), "path")
    return blocks.join(paths, F.col("key").eqNullSafe(F.col("path_key")) & (F.col("block") == F.col("path_block"))).drop("path_key", "path_block")


def _children(blocks: DataFrame, paths: DataFrame, name: str, most: int) -> DataFrame:
    """(key, name, digest, path to the root of the dataset) of each node of blocks, given the paths of the blocks' roots."""
    kind = blocks.schema["nodes"].dataType.elementType[name].dataType

    def work(batches):
        for key, total, nodes, path in _rows(batches, "key", "total", "nodes", "path"):
            tree, levels = _tree(nodes, total, most)
            each = [_pairs(tree.path(i, levels)) + path for i in range(len(nodes))]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(nodes), pa.string()), pa.array([n[name] for n in nodes], arrow), pa.array([n["digest"] for n in nodes]), pa.array(each, SIDES)], ["key", name, "digest", "path"])

    arrow = to_arrow_type(kind)
    return bound_batches(_with_paths(blocks, paths).select("key", "total", "nodes", "path")).mapInArrow(work, f"key string, {name} {kind.simpleString()}, digest string, path {PATH}")


@dataclass
class Forest:
    """Levels of blocks over numbered nodes, the lowest first, and the one node that is left of each key."""

    levels: list[DataFrame]
    roots: DataFrame
    most: int


def grow(nodes: DataFrame, columns: list[str], most: int = LEVELS) -> Forest:
    """Blocks of nodes (key, position, total, digest, ...) and of their roots, until each key has one node left."""
    levels = [_blocks(nodes, columns, most)]
    roots = materialize(_roots(levels[-1], most), "roots")
    while (roots.agg(F.max("total").alias("n")).first().n or 0) > 1:
        levels.append(_blocks(roots, ["digest"], most))
        roots = materialize(_roots(levels[-1], most), "roots")
    return Forest(levels, roots, most)


def _paths(forest: Forest, top: DataFrame) -> DataFrame:
    """(key, block, path) of the lowest blocks' roots, given the path of each key's root."""
    paths = top.select("key", F.lit(0).cast("long").alias("block"), "path")
    for blocks in reversed(forest.levels[1:]):
        paths = materialize(_children(blocks, paths, "position", forest.most).select("key", F.col("position").alias("block"), "path"), "paths")
    return paths


def manifest(docs: DataFrame, changed: Column | None = None, key: str = "lang", most: int = LEVELS) -> DataFrame:
    """doc_id, key, position, leaf, siblings (left and right, from the leaf up), subroot, root, version_root.

    changed: the text of a row after it was changed, null where it was not. version_root is the root of the version of the tree in
    which only this leaf differs, or the root refolded from the leaf itself. key is a text column; a block has ARITY ** most nodes.
    """
    text = F.lit(None).cast("string") if changed is None else changed
    leaves = docs.select(F.col(key).alias("key"), "doc_id", leaf(F.col("text")).alias("digest"), F.when(text.isNotNull(), leaf(text)).alias("changed"))
    forest = grow(numbered(leaves, "key", ["doc_id", "digest"]), ["doc_id", "digest", "changed"], most)
    partitions = forest.roots.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest")
    whole = grow(numbered(partitions, "key", ["name"]), ["name", "digest"], most)
    top = whole.roots.select("key", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    subroots = materialize(_children(whole.levels[0], _paths(whole, top), "name", most).select(F.col("name").alias("key"), F.col("digest").alias("subroot"), "path"), "subroots")
    roots = materialize(subroots.select(F.col("key").alias("root_key"), "subroot").crossJoin(F.broadcast(top.select("root"))), "ends")  # top is one row
    blocks = _with_paths(forest.levels[0], _paths(forest, subroots)).join(sized(roots, 256), F.col("key").eqNullSafe(F.col("root_key")))
    kind = docs.schema["doc_id"].dataType

    def work(batches):
        for name, total, nodes, path, subroot, root in _rows(batches, "key", "total", "nodes", "path", "subroot", "root"):
            tree, levels = _tree(nodes, total, most)
            above = [(p["left"].encode(), p["right"].encode()) for p in path]
            for lo in range(0, len(nodes), PROOFS):
                part = nodes[lo : lo + PROOFS]
                siblings = [tree.path(lo + i, levels) for i in range(len(part))]
                ends = [fold(tree.digests[tree.version(lo + i, n["changed"].encode(), levels)], above) if n["changed"] else fold(n["digest"].encode(), siblings[i] + above) for i, n in enumerate(part)]
                columns = [
                    pa.array([n["doc_id"] for n in part], arrow),
                    pa.array([name] * len(part), pa.string()),
                    pa.array([n["position"] for n in part], pa.int64()),
                    pa.array([n["digest"] for n in part]),
                    pa.array([_pairs(s) + path for s in siblings], SIDES),
                    pa.array([subroot] * len(part)),
                    pa.array([root] * len(part)),
                    pa.array([e.decode() for e in ends]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", key, "position", "leaf", "siblings", "subroot", "root", "version_root"])

    arrow = to_arrow_type(kind)
    found = bound_batches(blocks).select("key", "total", "nodes", "path", "subroot", "root")
    return found.mapInArrow(work, f"doc_id {kind.simpleString()}, `{key}` string, position long, leaf string, siblings {PATH}, subroot string, root string, version_root string")


def refold(leaf: Column, siblings: str) -> Column:
    """The root that a leaf and its siblings give: what a holder of a proof computes."""
    return F.aggregate(siblings, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def tampered(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 0, F.lit(False))


def digest(docs: DataFrame, most: int = LEVELS) -> DataFrame:
    """The manifest of docs where a third of the rows is tampered with, their proofs as digests."""
    found = manifest(docs, F.when(tampered(), lowered()), most=most)
    proof = F.sha2(F.array_join(F.transform("siblings", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), F.col("version_root").alias("folded_root"), (F.col("version_root") == F.col("root")).alias("verified"))


def _tree_sql(name: str, levels: int) -> str:
    """Tables name0 (key, pos, h) to its levels above, with the siblings to the left and right of each node, and `alone` for a lone one."""
    sides = "coalesce(string_agg(h, '') OVER (PARTITION BY key, pos // {a} ORDER BY pos ROWS BETWEEN {rows}), '')"
    left, right = sides.format(a=ARITY, rows="UNBOUNDED PRECEDING AND 1 PRECEDING"), sides.format(a=ARITY, rows="1 FOLLOWING AND UNBOUNDED FOLLOWING")
    out = []
    for k in range(levels):
        out.append(f"{name}s{k} AS (SELECT key, pos, h, {left} AS l, {right} AS r, count(*) OVER (PARTITION BY key) = 1 AS alone FROM {name}{k})")
        out.append(f"{name}{k + 1} AS (SELECT key, pos // {ARITY} AS pos, CASE WHEN any_value(alone) THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {name}s{k} GROUP BY key, pos // {ARITY})")
    return ",\n".join(out)


def _fold_sql(name: str, start: str, at: str, levels: int) -> str:
    """Tables that carry rows (key, `at`, d, proof) of `start` through the levels of a tree."""
    out, last = [], start
    for k in range(levels):
        now = f"{start}_{name}{k}"
        out.append(f"{now} AS (SELECT x.* REPLACE (CASE WHEN alone THEN d ELSE sha256(l || d || r) END AS d, CASE WHEN alone THEN proof ELSE proof || l || r END AS proof) FROM {last} x JOIN {name}s{k} s ON s.key IS NOT DISTINCT FROM x.key AND s.pos = x.{at} // {ARITY**k})")
        last = now
    return ",\n".join(out)


def oracle_sql(levels: int = 8) -> str:
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    row = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in FIELDS) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
leaves AS (SELECT doc_id, lang AS key, {row("text")} AS h, CASE WHEN doc_id IS NULL THEN false ELSE xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT)), lambda x, y: xor(t[1 + (xor(x, y) & 255)], x >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 3 = 0 END AS hit, {row(low)} AS changed FROM documents, crcs),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves),
n0 AS (SELECT key, pos, h FROM placed),
{_tree_sql("n", levels)},
subroots AS (SELECT key AS lang, h AS subroot, row_number() OVER (ORDER BY key NULLS FIRST) - 1 AS place FROM n{levels}),
g0 AS (SELECT 0 AS key, place AS pos, subroot AS h FROM subroots),
{_tree_sql("g", levels)},
a AS (SELECT doc_id, h AS leaf, key, pos, CASE WHEN hit AND changed IS NOT NULL THEN changed ELSE h END AS d, '' AS proof FROM placed),
{_fold_sql("n", "a", "pos", levels)},
b AS (SELECT doc_id, leaf, subroot, 0 AS key, place AS pos, d, proof FROM a_n{levels - 1} x JOIN subroots s ON s.lang IS NOT DISTINCT FROM x.key),
{_fold_sql("g", "b", "pos", levels)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, d AS folded_root, d = h AS verified FROM b_g{levels - 1}, g{levels}"""
