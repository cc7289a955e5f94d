"""Language identification: scripts narrow the candidates, Viterbi over word scores labels spans.

A word's score for a language is the sum of log-probabilities of its byte trigrams, learned from labelled rows. Script
ranges of code points rule out languages that never use the word's script; letters of scripts that aren't listed are a class of their own,
and what is no letter (signs, emoji, punctuation) counts for nothing. Viterbi with a constant penalty for each switch then labels every word, so that a document may hold spans of
several languages. Words are separated by ASCII white space: what is written without it (Chinese, Thai) is one word and one span.

Nulls and empty texts have no spans and are `und`; so are texts without a letter. Very long texts are labelled whole. Repeated
rows give repeated rows, null doc_ids are carried and learned from. Ties go to the language that sorts first. Without a labelled
row all are `und`. An empty table gives no rows. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, bound_batches, first_rows, slices, utf8, word_spans

BUCKETS = 1 << 15
#: Bound on the labelled rows that the model is fitted to.
MAX_TRAINING_ROWS = 20_000
SWITCH_PENALTY = 14.0
PART_BYTES, FEATURE_BYTES = 2 << 20, 1 << 19

#: Scripts by ranges of code points (blocks of Unicode).
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x250, 0x2AF), (0x300, 0x36F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F), (0xFB13, 0xFB17)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE)],
    "Devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    **{name: [(0x980 + 0x80 * i, 0x9FF + 0x80 * i)] for i, name in enumerate(("Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Thai", "Lao"))},
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "Ethiopic": [(0x1200, 0x139F), (0x2D80, 0x2DDF)],
    "Khmer": [(0x1780, 0x17FF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "Han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
_RANGES = sorted((lo, hi, i + 1) for i, ranges in enumerate(SCRIPTS.values()) for lo, hi in ranges)
_LOW, _HIGH, _NUMBER = (np.array(x) for x in zip(*_RANGES, strict=True))
#: Letters of all other scripts, by their Unicode category.
OTHER = len(SCRIPTS) + 1
N_SCRIPTS = OTHER + 1


@cache
def _letters() -> np.ndarray:
    """Is each code point a letter?"""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


@dataclass
class LanguageModel:
    """labels sorted; table[bucket, language] of centred log-probabilities; allowed[script, language]."""

    labels: list[str]
    table: np.ndarray
    allowed: np.ndarray


def byte_scripts(data: np.ndarray) -> np.ndarray:
    """The script of the code point that each byte of UTF-8 text belongs to; 0: none."""
    out = np.zeros(len(data), np.uint8)
    out[((data >= 0x41) & (data <= 0x5A)) | ((data >= 0x61) & (data <= 0x7A))] = list(SCRIPTS).index("Latin") + 1
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            at = np.minimum(lead + k, len(data) - 1)
            point = np.where(more, point << 6 | (data[at] & 0x3F), point)
        k = np.searchsorted(_LOW, point, "right") - 1
        script = np.where((k >= 0) & (point <= _HIGH[k]), _NUMBER[k], 0)
        rest = np.flatnonzero((script == 0) & (point >= 0x80))
        if len(rest):
            script[rest] = np.where(_letters()[np.minimum(point[rest], 0x10FFFF)], OTHER, 0)
        script = script.astype(np.uint8)
        for k in range(4):
            some = size > k
            out[np.minimum(lead[some] + k, len(data) - 1)] = script[some]
    return out


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Trigram bucket of each byte within a word (0: not a letter), each word's first such byte, and its script."""
    lengths = ends - starts
    first = first_rows(lengths)
    in_word = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    at = np.repeat(starts, lengths) + in_word
    low = ASCII_LOWER[data]
    a = low[at].astype(np.uint32)
    b = np.where(in_word > 0, low[at - 1], 32).astype(np.uint32)
    c = np.where(in_word > 1, low[at - 2], 32).astype(np.uint32)
    bucket = ((a | b << np.uint32(8) | c << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(17)
    scripts = byte_scripts(data)[at]
    letter = scripts > 0
    bucket = np.where(letter, np.maximum(bucket, 1), 0).astype(np.int32)
    script = np.maximum.reduceat(scripts, first) if len(first) else np.zeros(0, np.uint8)
    letters = np.add.reduceat(letter.astype(np.int32), first) if len(first) else np.zeros(0, np.int32)
    return bucket, first, script, letters


def train(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", max_rows: int = MAX_TRAINING_ROWS) -> LanguageModel:
    """Fit to the rows with a label, or to about max_rows of them chosen by a hash of the key."""
    rows = bound_batches(rows).filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    n = rows.select(label).count()
    if n > max_rows:
        rows = rows.filter(F.expr(f"pmod(xxhash64({key}), 1000000) < {max(1, int(1e6 * max_rows / n))}"))
    labels = sorted(r[0] for r in rows.select(label).distinct().collect())
    index = {x: i for i, x in enumerate(labels)}

    def count(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            of = np.array([index.get(x, 0) for x in batch.column(1).to_pylist()], np.int64)
            size = BUCKETS + N_SCRIPTS
            total = np.zeros(len(labels) * size, np.int64)
            for i, j in slices(offsets, FEATURE_BYTES):
                part = data[offsets[i] : offsets[j]]
                starts, ends, row = word_spans(part, offsets[i : j + 1] - offsets[i])
                if not len(starts):
                    continue
                bucket, _, script, _ = _features(part, starts, ends)
                lang = of[i + row]
                total += np.bincount(np.repeat(lang, ends - starts) * size + bucket, minlength=len(total))
                total += np.bincount(lang * size + BUCKETS + script, minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    counts = np.zeros((len(labels), BUCKETS + N_SCRIPTS))
    cells = rows.select(text, label).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most languages x buckets
    for cell, c in cells:
        counts.reshape(-1)[cell] = c
    grams = counts[:, :BUCKETS] + 0.5
    table = np.log(grams / grams.sum(1, keepdims=True)).T
    table = (table - table.mean(1, keepdims=True) if len(labels) else table).astype(np.float32)
    table[0] = 0
    scripts = counts[:, BUCKETS:].T
    allowed = scripts >= 0.001 * np.maximum(scripts.sum(0, keepdims=True), 1)
    allowed[0] = True
    allowed[~allowed.any(1)] = True
    return LanguageModel(labels, table, allowed)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each item; rows have counts items each, and a switch between neighbours costs penalty.

    All rows advance together, so the number of steps is the longest row's.
    """
    n, langs = scores.shape
    first = first_rows(counts)
    order = np.argsort(-counts, kind="stable")
    longest = int(counts[order[0]]) if len(order) else 0
    active = len(counts) - np.searchsorted(counts[order][::-1], np.arange(longest), "right")
    stay, jump, out = np.ones((n, langs), bool), np.zeros(n, np.int16), np.zeros(n, np.int16)
    start = first[order]
    best = None
    for t in range(longest):
        k = active[t]
        at = start[:k] + t
        if t == 0:
            best = scores[at].astype(np.float64)
            continue
        if k < len(best):
            out[start[k : len(best)] + t - 1] = best[k:].argmax(1)
            best = best[:k]
        top = best.argmax(1)
        other = best[np.arange(k), top][:, None] - penalty
        stay[at] = best >= other
        jump[at] = top
        best = np.maximum(best, other) - other + scores[at]
    if best is not None:
        out[start[: len(best)] + longest - 1] = best.argmax(1)
    for t in range(longest - 1, 0, -1):
        at = start[: active[t]] + t
        now = out[at]
        out[at - 1] = np.where(stay[at, now], now, jump[at])
    return out


SPANS = "array<struct<start:int,end:int,lang:string>>"


def label_spans(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), penalty: float = SWITCH_PENALTY) -> DataFrame:
    """keep, lang_pred, score (share of the letters in lang_pred's spans) and spans of words [start, end)."""
    schema = docs.select(*keep).schema.simpleString()[7:-1]
    bound_batches(docs)
    n_keep, labels, langs = len(keep), model.labels, len(model.labels)
    text_at = keep.index(text) if text in keep else n_keep + 1
    extra = [] if text in keep else [F.col(text)]
    found = docs.select(*keep, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("has_letter"), *extra)
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.allowed))

    def parts_of(batches):
        """Batches cut to rows of about PART_BYTES of text, which bounds what the scores and states of their words take."""
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0)
            for i, j in slices(np.concatenate(([0], np.cumsum(np.asarray(sizes), dtype=np.int64))), PART_BYTES):
                yield batch.slice(i, j - i)

    def label(batches):
        table, allowed = shared.value
        columns = [np.ascontiguousarray(table[:, i]) for i in range(langs)]
        for batch in parts_of(batches):
            rows = batch.num_rows
            if not langs:
                none = pa.array([[]] * rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(["und"] * rows), pa.array(np.zeros(rows)), none], [*batch.schema.names[:n_keep], "lang_pred", "score", "spans"])
                continue
            data, offsets = utf8(batch.column(text_at))
            parts, counts, weights = [], np.zeros(rows, np.int64), []
            for i, j in slices(offsets, FEATURE_BYTES):
                part = data[offsets[i] : offsets[j]]
                starts, ends, row = word_spans(part, offsets[i : j + 1] - offsets[i])
                counts[i:j] = np.bincount(row, minlength=j - i)
                if not len(starts):
                    continue
                bucket, first, script, letters = _features(part, starts, ends)
                scores = np.stack([np.add.reduceat(c[bucket], first) for c in columns], 1)
                parts.append(np.where(allowed[script], scores, scores - 1000))
                weights.append(letters)
            scores = np.concatenate(parts) if parts else np.zeros((0, langs), np.float32)
            letters = np.concatenate(weights) if weights else np.zeros(0, np.int32)
            state = viterbi(scores, counts, penalty).astype(np.int64)
            row = np.repeat(np.arange(rows), counts)
            share = np.bincount(row * langs + state, letters, minlength=rows * langs).reshape(rows, langs)
            top, total = share.argmax(1), share.sum(1)
            known = np.asarray(batch.column(n_keep)).astype(bool)
            score = np.where(known & (total > 0), share[np.arange(rows), top] / np.maximum(total, 1), 0.0)
            pred = np.where(known, np.array(labels, object)[top], "und")
            new = np.ones(len(state), bool)
            new[1:] = (state[1:] != state[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(new)
            in_row = np.arange(len(state)) - np.repeat(first_rows(counts), counts)
            stop = np.concatenate((begin[1:], [len(state)])) - 1 if len(begin) else begin
            spans = pa.StructArray.from_arrays([pa.array(in_row[begin].astype(np.int32)), pa.array((in_row[stop] + 1).astype(np.int32)), pa.array(np.array(labels, object)[state[begin]], pa.string())], ["start", "end", "lang"])
            cuts = np.concatenate(([0], np.cumsum(np.bincount(row[begin], minlength=rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(pred, pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(cuts), spans)], [*batch.schema.names[:n_keep], "lang_pred", "score", "spans"])

    return found.mapInArrow(label, f"{schema}, lang_pred string, score double, spans {SPANS}")


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, predict every row: doc_id, held_out, lang_pred, score, n_spans, spans."""
    model = train(docs.filter(~held_out()))
    found = label_spans(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"), "spans")
