"""Removal of repeated substrings with prefix-partitioned suffix trees.

A window is WINDOW consecutive words; a word is removed if a window that covers it also starts in a document with a
smaller doc_id. Suffixes enter the trees at anchors: in every window the PREFIX-gram with the smallest hash, so equal
windows have equal anchors at equal places, and an anchor serves a run of up to WINDOW - PREFIX + 1 windows.

1. A first pass counts the anchors and finds the hot prefixes, which more than HOT of the documents hold (there are at most
   1 / HOT times a document's anchors of them, so they are broadcast).
2. Every task gives its anchors, with a hash of the words that their windows span, to the partition of the anchor's
   prefix; there are as many partitions as keep each below PART anchors. Equal spans of a task are one leaf of the trees: only
   that of the smallest document travels as such; the others are removed already.
3. A partition drops prefixes of one document, which are almost all; of equal spans only the smallest document's stay open.
4. The open suffixes are grouped by prefix, a few groups at a time in memory. In each group a tree grows word by word to the
   right of the prefix, then to the left; branches of a single document end. Nodes at depth WINDOW with several documents are
   the repeats. A prefix with more than GROUP open suffixes, or a hot one, is lengthened to the whole window in one step, which
   an aggregation with partial sums counts: such a group would not fit one task, however its suffixes are spread.
5. The windows found are joined to their rows, whose covered words go: kept_texts() returns the text that stays and the
   ranges of words that went, which are maximal; remove_repeats() is a digest of it.

Words are runs of other bytes than ASCII white space, compared by 64-bit hashes of each word and of its neighbours. Null
text has no words, an empty one neither. Very long texts are read whole. Rows with a null doc_id lose nothing and take
nothing away. Rows that share a doc_id tie: none makes the other lose words, whether their texts are equal or not, and each
loses its own. Kept words are joined by single blanks. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _range_hashes, bound_batches, gram_hashes, materialize, mix, slices, utf8, word_hashes, word_spans

WINDOW, PREFIX, GROUP = 13, 6, 2000
#: Share of the documents from which on a prefix is hot, and anchors of a partition.
HOT, PART = 1 / 100, 500_000
SPAN = WINDOW - PREFIX + 1
# A prefix is known by its partition and 32 more bits; two that share both are only told apart later, by their words.
_RECORD = (("prefix", "<u4"), ("span", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("at", "<u4"), ("left", "u1"), ("n", "u1"))
_SIZE = sum(np.dtype(t).itemsize for _, t in _RECORD)


def _pack(fields: dict[str, np.ndarray]) -> bytes:
    return b"".join(fields[name].astype(kind).tobytes() for name, kind in _RECORD)


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {name: [np.zeros(0, kind)] for name, kind in _RECORD}
    for blob in blobs:
        n, at = len(blob) // _SIZE, 0
        for name, kind in _RECORD:
            parts[name].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(x) for name, x in parts.items()}


def anchors(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, first window and number of windows of each anchor of a sequence of words; windows stay within a row."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    order = gram_hashes(hashes, PREFIX)
    best, at = order[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, SPAN):
        other = order[j : j + n]
        less = other < best
        best[less] = other[less]
        at[less] = j
    start = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    place = start + at[start]
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    return place[first], start[first], np.diff(np.append(first, len(place)))


def _least(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest doc among the rows with each row's key."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(k)))
    low, high = np.empty_like(doc), np.empty_like(doc)
    if len(k):
        low[order] = np.repeat(np.minimum.reduceat(doc[order], first), sizes)
        high[order] = np.repeat(np.maximum.reduceat(doc[order], first), sizes)
    return low, high


def _anchors_of(batches):
    """Anchors of the (doc_id, tag, text) rows of each batch: number of rows and the fields of their records."""
    for batch in (whole.slice(k, 2500) for whole in batches for k in range(0, whole.num_rows, 2500)):
        doc_ids, tags = np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(1))
        data, offsets = utf8(batch.column(2))
        found: dict[str, list] = {name: [] for name, _ in _RECORD}
        for i, j in slices(offsets):
            part = data[offsets[i] : offsets[j]]
            starts, ends, row = word_spans(part, offsets[i : j + 1] - offsets[i])
            hashes = word_hashes(part, starts, ends)
            at, first, n = anchors(hashes, row)
            if not len(at):
                continue
            begin, owner = np.searchsorted(row, row[at]), i + row[at]
            span = _range_hashes(lambda lo, hi, h=hashes: h[lo:hi], len(hashes), first, first + n + WINDOW - 1)
            span = mix(span ^ (at - first).astype(np.uint64))
            prefix = _range_hashes(lambda lo, hi, h=hashes: h[lo:hi], len(hashes), at, at + PREFIX)
            for name, value in (("prefix", prefix), ("span", span), ("doc", doc_ids[owner]), ("tag", tags[owner]), ("at", at - begin), ("left", at - first), ("n", n)):
                found[name].append(value)
        if found["doc"]:
            yield batch.num_rows, {k: np.concatenate(v) for k, v in found.items()}


def _count_anchors(batches):
    """Per batch: the number of anchors (prefix null), and of each prefix that may be hot."""
    for rows, f in _anchors_of(batches):
        prefixes, n = np.unique(f["prefix"], return_counts=True)
        often = n > max(1, HOT * rows)
        yield pa.RecordBatch.from_arrays([pa.array([None, *prefixes[often].view(np.int64).tolist()], pa.int64()), pa.array([len(f["doc"]), *n[often].tolist()], pa.int64())], ["prefix", "n"])


#: What becomes of a record: its prefix decides in its partition, it is removed already, or its prefix is hot.
_OPEN, _DONE, _HOT = 0, 1, 2


def _anchor_rows(parts: int, hot):
    """(doc_id, tag, text) to (part, state, blob): anchors by the part of their prefix."""

    def emit(part: np.ndarray, state: int, fields: dict[str, np.ndarray]):
        order = np.argsort(part, kind="stable")
        fields = {k: v[order] for k, v in fields.items()}
        names, first = np.unique(part[order], return_index=True)
        ends = np.append(first[1:], len(order))
        blobs = [_pack({k: v[a:b] for k, v in fields.items()}) for a, b in zip(first, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array([state] * len(names), pa.int32()), pa.array(blobs, pa.binary())], ["part", "state", "blob"])

    def work(batches):
        frequent = hot.value
        for _, fields in _anchors_of(batches):
            low, _ = _least(fields["span"], fields["doc"])
            again = fields["doc"] > low
            near = ~again & np.isin(fields["prefix"], frequent)
            for state, chosen in ((_OPEN, ~again & ~near), (_DONE, again), (_HOT, near)):
                if chosen.any():
                    some = {k: v[chosen] for k, v in fields.items()}
                    key = some["prefix"] if state == _OPEN else mix(some["doc"].astype(np.uint64))
                    yield emit((key % np.uint64(parts)).astype(np.int64), state, {**some, "prefix": some["prefix"] >> np.uint64(32)})

    return work


FOUND = "doc_id long, tag int, first int, n int, at int"


def _repeated(group: int):
    """All blobs of a partition to (doc_id, first, n, at): at -1: these windows go; at >= 0: open; at < -1: open under -2 - at, of a frequent prefix."""

    def work(batches):
        blobs: tuple[list, list, list] = [], [], []
        for batch in batches:
            for state, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                blobs[state].append(blob)
        f, done, hot = ({**x, "first": x["at"].astype(np.int64) - x["left"]} for x in map(_unpack, blobs))
        low, high = _least(f["prefix"], f["doc"])
        keep = low < high
        f = {k: v[keep] for k, v in f.items()}
        low, _ = _least(f["span"], f["doc"])
        gone = f["doc"] > low
        # spans still open, by prefix; one span alone has nothing to be compared with
        o = {k: v[~gone] for k, v in f.items()}
        _, inverse = np.unique(o["prefix"], return_inverse=True)
        first_span, last_span = _least(o["prefix"], o["span"].view(np.int64))
        several = first_span != last_span
        sizes = np.bincount(inverse)
        at = o["at"].astype(np.int64)
        at = np.where(sizes[inverse] > group, -2 - at, at)[several] if len(inverse) else at
        sure = np.full(len(done["doc"]) + int(gone.sum()), -1)
        out = [np.concatenate((done[k], f[k][gone], o[k][several], hot[k])) for k in ("doc", "tag", "first", "n")]
        out.append(np.concatenate((sure, at, -2 - hot["at"].astype(np.int64))))
        for i in range(0, len(out[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000].astype(t)) for x, t in zip(out, (np.int64, np.int32, np.int32, np.int32, np.int32), strict=True)], ["doc_id", "tag", "first", "n", "at"])

    return work


def _split_rows(batches):
    """(doc_id, tag, text, found) to rows with the words of documents without repeats; the others keep their text and what was found."""
    for whole in batches:
        for k in range(0, whole.num_rows, 1024):
            batch = whole.slice(k, 1024)
            data, offsets = utf8(batch.column(2))
            texts = batch.column(2).is_valid()
            plain = np.asarray(batch.column(3).is_null()) & np.asarray(texts)
            counts, kept = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for i in np.flatnonzero(plain):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                counts[i], kept[i] = len(words), b" ".join(words)
            text = batch.column(2).take(pa.array(np.arange(batch.num_rows), mask=plain))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(kept, pa.binary()).cast(pa.string()), text, batch.column(3)], ["doc_id", "tag", "n_words", "kept", "text", "found"])


def _open_suffixes(frequent: bool):
    """(doc_id, tag, text, found) to the suffixes at open anchors: as words from `left` words before the anchor, or window by window."""

    def work(batches):
        for batch in (whole.slice(k, 1024) for whole in batches for k in range(0, whole.num_rows, 1024)):
            data, offsets = utf8(batch.column(2))
            found = batch.column(3)
            cuts, rows = np.asarray(found.offsets), found.flatten()
            first, n, at = (np.asarray(rows.field(x)).astype(np.int64) for x in ("first", "n", "at"))
            cuts = cuts - cuts[0]
            docs, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for r in range(batch.num_rows):
                mine = np.arange(cuts[r], cuts[r + 1])
                mine = mine[at[mine] < -1] if frequent else mine[at[mine] >= 0]
                if not len(mine):
                    continue
                part = data[offsets[r] : offsets[r + 1]]
                starts, ends, _ = word_spans(part, np.array([0, len(part)]))
                hashes = word_hashes(part, starts, ends)
                mine = mine[first[mine] + n[mine] + WINDOW - 1 <= len(hashes)]
                if frequent:
                    window = np.repeat(first[mine], n[mine]) + np.arange(int(n[mine].sum())) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])
                    order = np.argsort(window)
                    window = window[order]
                    sums = _range_hashes(lambda lo, hi, h=hashes: h[lo:hi], len(hashes), window, window + WINDOW)
                    other = _range_hashes(lambda lo, hi, h=hashes: mix(h[lo:hi]), len(hashes), window, window + WINDOW)
                    for column, value in zip(out, ([docs[r]] * len(window), [tags[r]] * len(window), window, sums.view(np.int64), other.view(np.int64)), strict=True):
                        column += list(value)
                else:
                    for i in mine:
                        out[0].append(docs[r])
                        out[1].append(tags[r])
                        out[2].append(int(at[i]))
                        out[3].append(int(at[i] - first[i]))
                        out[4].append(hashes[first[i] : first[i] + n[i] + WINDOW - 1].tobytes())
            if frequent:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "tag", "first", "a", "b"])
            else:
                prefix = [x[8 * left : 8 * left + 8 * PREFIX] for x, left in zip(out[4], out[3], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(prefix, pa.binary()), *(pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True))], ["prefix", "doc_id", "tag", "at", "left", "words"])

    return work


def subtree_repeats(node: np.ndarray, words: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Windows that a smaller document holds too, as (suffix, words left of the anchor).

    node: subtree (prefix) of each suffix; words[suffix, SPAN - 1 + WINDOW]: its words from SPAN - 1 before the anchor;
    left, right: how many words before and from the anchor are known. The tree grows a word at a time; branches in which all
    suffixes are of one document end, as no repeat lies below them.
    """

    def grow(node: np.ndarray, alive: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        child = mix(node[alive] * np.uint64(0x9E3779B97F4A7C15) + column[alive])
        low, high = _least(child, doc[alive])
        keep = low < high
        alive = alive[keep]
        out = np.zeros(len(node), np.uint64)
        out[alive] = child[keep]
        return out, alive

    anchor = SPAN - 1
    level, alive = node, np.arange(len(node))
    levels = {PREFIX: (level, alive)}
    for depth in range(PREFIX, WINDOW):
        alive = alive[right[alive] > depth]
        level, alive = grow(level, alive, words[:, anchor + depth])
        levels[depth + 1] = (level, alive)
    for back in range(SPAN):
        level, alive = levels[WINDOW - back]
        alive = alive[left[alive] >= back]
        for j in range(1, back + 1):
            level, alive = grow(level, alive, words[:, anchor - j])
        low, _ = _least(level[alive], doc[alive])
        for i in alive[doc[alive] > low]:
            yield int(i), back


#: Suffixes that a task holds at once; groups of one prefix stay together.
_HELD = 20_000


def _grow_trees(batches):
    """Suffixes in the order of their prefixes to the (doc_id, tag, first) of repeated windows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _HELD:
            rows = pa.concat_tables(pa.Table.from_batches([b]) for b in held)
            prefixes = rows.column("prefix").to_pylist()
            cut = next((k for k in range(len(prefixes) - 1, 0, -1) if prefixes[k] != prefixes[k - 1]), 0)
            if cut:
                yield _trees(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
    if held:
        yield _trees(pa.concat_tables(pa.Table.from_batches([b]) for b in held))


def _trees(rows: pa.Table) -> pa.RecordBatch:
    _, node = np.unique(np.frombuffer(b"".join(rows.column("prefix").to_pylist()), f"V{8 * PREFIX}"), return_inverse=True)
    doc, tag, at, left = (np.asarray(rows.column(x)).astype(np.int64) for x in ("doc_id", "tag", "at", "left"))
    raw = rows.column("words").to_pylist()
    right = np.array([len(x) // 8 for x in raw]) - left
    words = np.zeros((len(raw), SPAN - 1 + WINDOW), np.uint64)
    for i, x in enumerate(raw):
        known = np.frombuffer(x, np.uint64)
        words[i, SPAN - 1 - left[i] : SPAN - 1 - left[i] + len(known)] = known
    found = np.array(list(subtree_repeats(node.astype(np.uint64), words, doc, left, right)), np.int64).reshape(-1, 2)
    at = (at[found[:, 0]] - found[:, 1]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(doc[found[:, 0]]), pa.array(tag[found[:, 0]].astype(np.int32)), pa.array(at)], ["doc_id", "tag", "first"])


def _keep_rest(batches):
    """(doc_id, text, found, more) to (doc_id, n_words, kept, removed)."""
    for batch in (whole.slice(k, 1024) for whole in batches for k in range(0, whole.num_rows, 1024)):
        data, offsets = utf8(batch.column(1))
        found, more = batch.column(2), batch.column(3)
        rows, f_cut = found.flatten(), np.asarray(found.offsets)
        first, n, at = (np.asarray(rows.field(x)).astype(np.int64) for x in ("first", "n", "at"))
        late, m_cut = np.asarray(more.flatten()).astype(np.int64), np.asarray(more.offsets)
        f_cut, m_cut = f_cut - f_cut[0], m_cut - m_cut[0]
        total, removed, kept = [], [], []
        for r in range(batch.num_rows):
            words = data[offsets[r] : offsets[r + 1]].tobytes().split()
            sure = np.arange(f_cut[r], f_cut[r + 1])
            sure = sure[at[sure] == -1]
            alone = late[m_cut[r] : m_cut[r + 1]]
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, np.minimum(np.concatenate((first[sure], alone)), len(words)), 1)
            np.add.at(change, np.minimum(np.concatenate((first[sure] + n[sure] + WINDOW - 1, alone + WINDOW)), len(words)), -1)
            covered = np.cumsum(change[:-1]) > 0
            total.append(len(words))
            edge = np.flatnonzero(np.diff(np.concatenate(([0], covered, [0])))).tolist()
            removed.append([{"start": i, "end": j} for i, j in zip(edge[::2], edge[1::2], strict=True)])
            kept.append(b" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c))
        ranges = pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), ranges], ["doc_id", "n_words", "kept", "removed"])


RANGES = "array<struct<start:int,end:int>>"


def kept_texts(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, kept (the text that stays, null for a null text), removed (ranges [start, end) of words, in order) of every row."""
    spark = docs.sparkSession
    # rows are told apart by doc_id and a hash of the text; equal rows have equal results
    docs = bound_batches(docs).select("doc_id", F.hash("text").alias("tag"), "text")
    valid = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    counts = materialize(valid.mapInArrow(_count_anchors, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")), "prefixes")
    total = counts.filter("prefix IS NULL").first()
    hot = counts.filter(F.col("prefix").isNotNull() & (F.col("n") > HOT * valid.count())).select("prefix").collect()  # at most 1 / HOT times a document's anchors
    shared = spark.sparkContext.broadcast(np.sort(np.array([r.prefix for r in hot], np.int64).view(np.uint64)))
    parts = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total.n if total else 0) // PART))
    rows = valid.mapInArrow(_anchor_rows(parts, shared), "part int, state int, blob binary")
    repeated = rows.repartition(parts, "part").mapInArrow(_repeated(group), FOUND)
    per_doc = repeated.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "n", "at")).alias("found"))
    joined = docs.join(per_doc, ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "found")
    found = "array<struct<first:int,n:int,at:int>>"
    split = materialize(joined.mapInArrow(_split_rows, f"doc_id long, tag int, n_words long, kept string, text string, found {found}"), "split")
    touched = split.filter("found IS NOT NULL").select("doc_id", "tag", "text", "found")

    suffixes = touched.filter("exists(found, x -> x.at >= 0)").mapInArrow(_open_suffixes(False), "prefix binary, doc_id long, tag int, at int, left int, words binary")
    in_trees = suffixes.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_grow_trees, "doc_id long, tag int, first int")
    windows = materialize(touched.filter("exists(found, x -> x.at < -1)").mapInArrow(_open_suffixes(True), "doc_id long, tag int, first int, a long, b long"), "windows")
    lowest = windows.groupBy("a", "b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").drop("high")
    whole = windows.join(lowest, ["a", "b"]).filter("doc_id > low").select("doc_id", "tag", "first")
    more = in_trees.unionByName(whole).groupBy("doc_id", "tag").agg(F.collect_list("first").alias("more"))
    rest = touched.join(more, ["doc_id", "tag"], "left").select("doc_id", "text", "found", F.coalesce("more", F.array().cast("array<int>")).alias("more"))
    cut = rest.mapInArrow(_keep_rest, f"doc_id long, n_words long, kept string, removed {RANGES}")
    clean = split.filter("found IS NULL").select("doc_id", "n_words", "kept", F.array().cast(RANGES).alias("removed"))
    return clean.unionByName(cut)


def digest(texts: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the rows of kept_texts()."""
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return texts.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2(F.encode(F.coalesce("kept", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """The digest of what stays of every row."""
    return digest(kept_texts(docs, group))
