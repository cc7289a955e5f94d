"""Near-duplicate documents by Order MinHash.

Words are split at ASCII white space and lower-cased (A-Z); shingles are five words, labelled with their occurrence
number in the document, so that each is unique there (a text of one to four words has one shingle). For each of TABLES
tables the PICKS smallest labelled shingles under that table's hash are kept and joined in text order; documents with
an equal key are candidates. A candidate pair is verified by banded alignment: as labelled shingles are unique, the
longest common subsequence inside the diagonal band that the threshold allows is a longest increasing run of matched
positions. Similarity = aligned shingles / shingles of the longer document; a pair links at 0.8 or more.

Equal texts are one node. Each bucket's members are first compared with the bucket's smallest member, which is linear
for groups of copies; all pairs of what is then still in different components of one bucket are compared in blocks, so
no link inside a bucket is lost and no task holds a bucket. A block's shared shingles come from one matrix product, and
only pairs that share enough are aligned. A table's picks all fall among the shared shingles of a pair that shares m of n with a
probability of C(m, 3) / C(2n - m, 3): a pair of long texts at the threshold meets in no bucket with a probability of 5e-5, one of
similarity 0.9 with 1e-10, while of short ones (8 of 10 shingles) 3e-4 and of the shortest (4 of 5) 2e-3 are missed. Texts are
shuffled for those in buckets only. Classes are the connected components of the links.

Null text: a class of its own. Empty text (no word): one class of all texts equal to it. Very long texts are compared whole;
blocks are bounded by bytes as well as by rows. Rows that share a doc_id count as one document. Ties: the smallest doc_id names a
class. Null doc_id: class null, kept. An empty table gives no rows. Columns beside doc_id and text, whatever their names, are not
read by near_duplicates().
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, connected_components, first_rows, gram_hashes, materialize, mix, sized, slices, utf8, word_hashes, word_spans

WORDS, SIMILARITY, TABLES, PICKS = 5, 0.8, 28, 3
#: Rows of a bucket that one group compares with each other in the second step.
BLOCK = 512
#: Bytes of text of such a block.
BLOCK_BYTES = 16 << 20
_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_TOP = np.uint64(0xFFFFFFFF00000000)


def labelled_shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled shingles of all rows, shingles per row, words per row."""
    starts, ends, row = word_spans(data, offsets)
    rows = len(offsets) - 1
    words = np.bincount(row, minlength=rows)
    hashes = word_hashes(data, starts, ends, lower=True)
    first = first_rows(words)
    counts = np.where(words >= k, words - k + 1, (words > 0).astype(words.dtype))
    grams = np.concatenate((gram_hashes(hashes, k), np.zeros(min(k - 1, len(hashes)), np.uint64)))
    of = np.repeat(np.arange(rows), counts)
    at = np.repeat(first, counts) + np.arange(len(of)) - np.repeat(first_rows(counts), counts)
    grams = grams[at]
    short, at_row = np.flatnonzero((words > 0) & (words < k)), first_rows(counts)
    for r in short:
        h = np.uint64(words[r])
        for w in hashes[first[r] : first[r] + words[r]]:
            h = mix(np.array([h ^ w]))[0]
        grams[at_row[r]] = h
    # the n-th equal shingle of a row gets label n
    order = np.lexsort((grams, of))
    g, o = grams[order], of[order]
    same = np.zeros(len(g), bool)
    same[1:] = (g[1:] == g[:-1]) & (o[1:] == o[:-1])
    if same.any():
        at = np.arange(len(g))
        run = at - np.maximum.accumulate(np.where(same, 0, at))
        grams[order[same]] = mix(g[same] + run[same].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return grams, counts, words


def order_keys(grams: np.ndarray, counts: np.ndarray, tables: int = TABLES, picks: int = PICKS) -> np.ndarray:
    """keys[row, table] for the rows that have shingles."""
    counts = counts[counts > 0]
    first = first_rows(counts)
    in_row = (np.arange(len(grams)) - np.repeat(first, counts)).astype(np.uint64)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    keys = np.empty((len(counts), tables), np.uint64)
    for t in range(tables):
        value = (grams ^ _SEEDS[t]) * np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
        value *= np.uint64(0x94D049BB133111EB)
        value = (value & _TOP) | in_row
        picked = np.full((len(counts), picks), -1, np.int64)
        for p in range(picks):
            low = np.minimum.reduceat(value, first) if len(first) else value
            some = low != none if p else np.ones(len(low), bool)
            at = first + (low & ~_TOP).astype(np.int64)
            picked[some, p] = at[some]
            value[at[some]] = none
        picked.sort(1)
        key = np.full(len(counts), _SEEDS[128 + t])
        for p in range(picks):
            key = mix(key ^ np.where(picked[:, p] >= 0, grams[picked[:, p]], np.uint64(p)))
        keys[:, t] = key
    return keys


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned shingles of the banded alignment / the longer length; 0 where the bound rules out least."""
    longer = max(len(a), len(b))
    if not longer or min(len(a), len(b)) < least * longer:
        return 0.0
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = longer - int(np.ceil(least * longer))
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < least * longer:
        return 0.0
    chain: list[int] = []
    for x in j[np.argsort(i)].tolist():
        k = bisect_left(chain, x)
        if k == len(chain):
            chain.append(x)
        else:
            chain[k] = x
    return len(chain) / longer


def overlaps(grams: list[np.ndarray]) -> np.ndarray:
    """Number of shared shingles of every two rows, from the shingles that stand in more than one."""
    n = len(grams)
    unique, inverse, often = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(g) for g in grams])
    keep = often[inverse] > 1
    column, row = (np.cumsum(often > 1) - 1)[inverse[keep]], row[keep]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((n, 4096), np.float32)
        part[row[i:j], column[i:j] - lo] = 1
        out += part @ part.T
    return out


def _sketches(docs: DataFrame, tables: int, picks: int) -> DataFrame:
    def sketch(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            parts, sizes = [], np.zeros(batch.num_rows, np.int64)
            for i, j in slices(offsets):
                grams, counts, _ = labelled_shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sizes[i:j] = counts
                parts.append(order_keys(grams, counts, tables, picks))
            keys = np.concatenate(parts) if parts else np.zeros((0, tables), np.uint64)
            cuts = np.concatenate(([0], np.cumsum(np.where(sizes > 0, tables, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys.reshape(-1).view(np.int64)))], ["doc_id", "digest", "bytes", "keys"])

    rows = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("bytes"), "text")
    return rows.mapInArrow(sketch, "doc_id long, digest binary, bytes long, keys array<long>")


def _shingles_of(texts: pa.Array) -> list[np.ndarray]:
    data, offsets = utf8(texts)
    grams, counts, _ = labelled_shingles(data, offsets)
    return np.split(grams, np.cumsum(counts)[:-1]) if len(counts) else []


def _verify_pairs(least: float):
    """(a, b, text_a, text_b) batches to the linked (a, b)."""

    def verify(batches):
        leader, of_leader = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                left = _shingles_of(part.column(2))
                kept = []
                for k in range(len(a)):
                    if b[k] != leader:
                        leader, of_leader = b[k], _shingles_of(part.column(3).slice(k, 1))[0]
                    if similarity(left[k], of_leader, least) >= least:
                        kept.append(k)
                yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in kept], pa.int64()), pa.array([b[k] for k in kept], pa.int64())], ["a", "b"])

    return verify


def _verify_blocks(least: float):
    """Groups of (group, side, node, component, text), sorted by group: links that join components, found within each group."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        grams = _shingles_of(pa.array([r[4] for r in rows], pa.string()))
        shared = overlaps(grams)
        longer = np.maximum.outer(*[np.array([len(g) for g in grams])] * 2)
        side, component = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
        test = (shared >= least * longer) & (component[:, None] != component)
        if len(set(side.tolist())) > 1:
            test &= side[:, None] != side
        found = []
        for x, y in zip(*np.nonzero(np.triu(test, 1)), strict=True):
            p, q = find(rows[x][3]), find(rows[y][3])
            if p != q and similarity(grams[x], grams[y], least) >= least:
                parent[max(p, q)] = min(p, q)
                found.append((rows[x][2], rows[y][2]))
        return found

    def verify(batches):
        group, rows = None, []

        def links(rows):
            found = solve(rows)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != group:
                    if len(rows) > 1:
                        yield links(rows)
                    group, rows = row[0], []
                rows.append(row)
        if len(rows) > 1:
            yield links(rows)

    return verify


def _unsettled(members: DataFrame, comps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of buckets that hold several components; minor: not in the leader's component."""
    placed = members.join(comps.withColumnRenamed("node", "known"), F.col("node") == F.col("known"), "left").select("bucket", "leader", "node", F.coalesce("component", "node").alias("component"))
    leads = placed.filter("node = leader").select("bucket", F.col("component").alias("lead"))
    parts = placed.join(leads, "bucket").select("bucket", "node", "component", (F.col("component") != F.col("lead")).alias("minor"))
    open_ = parts.groupBy("bucket").agg(F.count_if("minor").alias("n_minor")).filter("n_minor > 0").select("bucket")
    rows = parts.join(open_, "bucket").join(nodes.select("node", "bytes"), "node")
    some = lambda minor: F.greatest(F.count_if(minor) / BLOCK, F.sum(F.when(minor, F.col("bytes")).otherwise(0)) / BLOCK_BYTES)
    sizes = rows.groupBy("bucket").agg(F.ceil(some(~F.col("minor"))).cast("int").alias("majors"), F.ceil(some(F.col("minor"))).cast("int").alias("minors"))
    return rows.drop("bytes").join(sizes, "bucket")


def _blocks(unsettled: DataFrame) -> DataFrame:
    """Groups of at most two blocks of a bucket's members, which between them hold all its pairs but those in the leader's component."""
    own = F.expr("CASE WHEN minor THEN majors + pmod(hash(node), minors) ELSE pmod(hash(node), majors) END")
    others = F.expr("CASE WHEN minor THEN sequence(0, majors + minors - 1) ELSE sequence(majors, majors + minors - 1) END")
    exploded = unsettled.withColumn("side", own).withColumn("other", F.explode(others))
    return exploded.select("node", "component", F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other")).alias("group"), "side")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, tables: int = TABLES, picks: int = PICKS) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest doc_id of its class), kept (doc_id = class_id)."""
    docs = bound_batches(docs).select("doc_id", "text")
    sketches = materialize(_sketches(docs, tables, picks), "sketches")
    nodes = sketches.filter("doc_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest", "keys").agg(F.min("doc_id").alias("node"), F.max("bytes").alias("bytes"))
    nodes = materialize(nodes, "nodes")
    rows = nodes.filter("size(keys) > 0").select("node", F.posexplode("keys").alias("t", "key")).select(F.xxhash64("t", "key").alias("bucket"), "node")
    buckets = rows.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    members = materialize(rows.join(buckets.drop("n"), "bucket"), "members")
    pairs = members.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    wanted = sized(materialize(members.select(F.col("node").alias("doc_id")).distinct(), "wanted"))
    texts = materialize(docs.join(wanted, "doc_id", "left_semi").filter("text IS NOT NULL").select("doc_id", "text"), "texts")
    first = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    links = materialize(first.select("a", "b", "text_a", "text_b").mapInArrow(_verify_pairs(least), "a long, b long"), "links")

    # what is still in several components of one bucket
    comps = materialize(connected_components(links), "components")
    unsettled = materialize(_unsettled(members, comps, nodes), "unsettled")
    blocks = _blocks(unsettled).join(texts, F.col("node") == texts.doc_id).select("group", "side", "node", "component", "text")
    late = blocks.repartition("group").sortWithinPartitions("group", "side", "node").mapInArrow(_verify_blocks(least), "a long, b long")
    late = materialize(late, "late_links")
    if late.limit(1).count():
        comps = materialize(connected_components(links.union(late)), "components")

    # rows that share a doc_id are one document: its texts join one class
    seen = sketches.filter("doc_id IS NOT NULL AND digest IS NOT NULL").join(nodes.select("digest", "node"), "digest")
    named = seen.join(comps, "node", "left").select("doc_id", F.coalesce("component", "node").alias("class_id"))
    return _classes(sketches, named)


def _classes(sketches: DataFrame, named: DataFrame) -> DataFrame:
    by_doc = named.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("class_id").alias("other"))
    by_doc = materialize(by_doc, "by_doc")
    several = by_doc.filter("class_id <> other").select(F.col("class_id").alias("a"), F.col("other").alias("b"))
    if several.limit(1).count():
        merged = connected_components(named.select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")))
        by_doc = merged.select(F.col("node").alias("doc_id"), F.col("component").alias("class_id"))
    out = sketches.select("doc_id").join(by_doc.select("doc_id", "class_id"), "doc_id", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))
