"""Keyword top-k by upper bounds: a MaxScore walk over the postings of blocks of chunks.

A chunk's score for a query is the number of words that they share over the root of the product of both sizes. Tasks put the chunks of an Arrow batch in
order of their size and cut them into blocks; a block has the postings of its words and, of each word, the greatest part that it can add to a score. For a
query, the words with the longest postings are set aside as long as all of them together can't reach the query's kth score so far; only chunks
that hold one of the others are looked at, and given up once what is left can't bring them there. Each task returns at most k chunks a query, so that
is all that is shuffled. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512
#: Words of the queries that are searched for in one pass over the chunks, about.
PASS_WORDS = 2 << 20
_STEP = Decimal("0.0001")


def rounded(score: float) -> float:
    """Four digits, half up, as scores are reported and compared."""
    return float(Decimal(repr(score)).quantize(_STEP, ROUND_HALF_UP))


@dataclass
class Postings:
    """A block of chunks in ascending size: members[first[w]:first[w + 1]] hold word w; most[w] is the greatest 1 / sqrt(size) of them."""

    ids: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    members: np.ndarray
    most: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, sizes: np.ndarray, row: np.ndarray, word: np.ndarray, n_words: int) -> Postings:
        order = np.lexsort((row, word))
        word, members = word[order], row[order]
        first = np.searchsorted(word, np.arange(n_words + 1))
        some = first[:-1] < first[1:]
        most = np.zeros(n_words)
        most[some] = 1 / np.sqrt(sizes[members[first[:-1][some]]])  # members ascend, and sizes with them
        return cls(ids, sizes, first, members, most)


@dataclass
class TopK:
    """The best k chunks of each query so far, as (-score, chunk)."""

    k: int
    words: list[np.ndarray]
    sizes: np.ndarray
    best: list[list[tuple[float, int]]] = field(default_factory=list)
    looked_at: int = 0
    pairs: int = 0

    def __post_init__(self):
        self.best = [[] for _ in self.words]

    def add(self, block: Postings) -> None:
        for q in range(len(self.words)):
            self._walk(q, block)

    def _walk(self, q: int, block: Postings) -> None:
        self.pairs += len(block.ids)
        best = self.best[q]
        least = -best[-1][0] - 0.00005 - 1e-12 if len(best) == self.k else 0.0  # what rounds to the kth score
        words, root = self.words[q], np.sqrt(self.sizes[q])
        lengths = block.first[words + 1] - block.first[words]
        words = words[lengths > 0]
        order = np.argsort(-lengths[lengths > 0], kind="stable")
        words, reach = words[order], np.cumsum(block.most[words[order]]) / root
        aside = int(np.searchsorted(reach, least)) if least > 0 else 0  # all of these together stay below
        if aside == len(words):
            return
        shared = np.zeros(len(block.ids), np.int32)
        for w in words[aside:]:
            shared[block.members[block.first[w] : block.first[w + 1]]] += 1
        bound = root * np.sqrt(np.maximum(block.sizes, 1))
        alive = shared > 0
        self.looked_at += int(alive.sum())
        for left in range(aside, 0, -1):
            alive &= (shared + left) / bound >= least
            if not alive.any():
                return
            w = words[left - 1]
            shared[block.members[block.first[w] : block.first[w + 1]]] += 1
        scores = shared / bound
        for i in np.flatnonzero(alive & (scores >= least)):
            entry = (-rounded(float(scores[i])), int(block.ids[i]))
            if entry[0] < 0 and (len(best) < self.k or entry < best[-1]):
                best.append(entry)
                best.sort()
                del best[self.k :]


def _search_task(shared, k: int, report: bool):
    def work(batches):
        known, words, sizes, query_ids = shared.value
        top = TopK(k, words, sizes)
        for batch in batches:
            ids, lists = np.asarray(batch.column(0)), batch.column(1)
            n = np.diff(np.asarray(lists.offsets))
            hashes = np.asarray(lists.flatten())
            row = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
            order = np.argsort(n, kind="stable")
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n))
            place, word = rank[row[hit]], at[hit]
            by = np.argsort(place, kind="stable")
            place, word = place[by], word[by]
            for lo in range(0, len(n), BLOCK):
                i, j = np.searchsorted(place, [lo, lo + BLOCK])
                part = order[lo : lo + BLOCK]
                top.add(Postings.build(ids[part], n[part], place[i:j] - lo, word[i:j], len(known)))
        if report:
            yield pa.RecordBatch.from_arrays([pa.array([top.pairs]), pa.array([top.looked_at])], ["pairs", "looked_at"])
            return
        found = [(q, chunk, -score) for q, best in zip(query_ids, top.best, strict=True) for score, chunk in best]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "chunk_id", "score"])

    return work


def _passes(chunks: DataFrame, queries: DataFrame, words_of, k: int, report: bool, schema: str) -> DataFrame:
    hashes = lambda text: F.transform(words_of(text), lambda w: F.xxhash64(w))
    body = chunks.select(F.col("chunk_id").cast("long"), F.coalesce(hashes("text"), F.array().cast("array<long>")).alias("words"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), hashes("text").alias("words")).filter(F.size("words") > 0)
    n = -(-(asked.agg(F.sum(F.size("words"))).first()[0] or 0) // PASS_WORDS)
    out = chunks.sparkSession.createDataFrame([], schema)
    for p in range(n):
        rows = asked.filter(f"pmod(xxhash64(query_id), {n}) = {p}").collect()  # bounded by PASS_WORDS
        if rows:
            known = np.unique(np.concatenate([np.asarray(r.words, np.int64) for r in rows]))
            words = [np.searchsorted(known, np.unique(np.asarray(r.words, np.int64))) for r in rows]
            shared = chunks.sparkSession.sparkContext.broadcast((known, words, np.array([len(r.words) for r in rows]), [r.query_id for r in rows]))
            out = out.unionByName(body.mapInArrow(_search_task(shared, k, report), schema))
    return out


def keyword_top_k(chunks: DataFrame, queries: DataFrame, words_of, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank of the k best chunks(chunk_id, text) of each of queries(query_id, text); equal scores by chunk_id."""
    found = _passes(chunks, queries, words_of, k, False, "query_id long, chunk_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def keyword_work(chunks: DataFrame, queries: DataFrame, words_of, k: int) -> DataFrame:
    """pairs of queries and chunks, and how many of them were looked at."""
    return _passes(chunks, queries, words_of, k, True, "pairs long, looked_at long").agg(F.sum("pairs").alias("pairs"), F.sum("looked_at").alias("looked_at"))
