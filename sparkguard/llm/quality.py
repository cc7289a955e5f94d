"""Quality classifier by positive-unlabelled learning.

A text becomes STATISTICS of its bytes and words (shares of letters, capitals, digits, signs, separators, repeated words and lines, lengths),
each compared with quantiles of all documents; a linear model g of these comparisons gives the score, the logistic of g. Trusted positives are
documents with label 1, everything is unlabelled; labels of 0 are not used. With the logistic loss the unbiased risk is convex:

    risk = prior * E_positive[l(g)] + (E_all[l(-g)] - prior * E_positive[l(-g)])  =  E_all[softplus(g)] - prior * E_positive[g]

The bracket is the risk of the negatives, which can't be below 0: where it would be, the non-negative risk leaves it out. That risk is minimised
exactly by its dual (see minimise()), with Newton steps over all documents: tasks add up gradients and curvatures, the driver solves a system of the
size of the features.

The class prior is estimated from the scores of a first model that tells one half of the positives from all, on the other half: among the documents with the highest scores are
hardly any but positives, so the least ratio, over all thresholds, of the share of all documents above it to the share of positives above it (each
with a bound for its sampling error) bounds the prior.

Nulls and empty texts have no letter and no word; they get the score of such texts. Very long texts are read whole. Repeated rows are scored alike, rows
that share a doc_id count each, those of a null doc_id have no label. Documents with several labels count as positive if one is 1. Without a positive label
all scores are 0.5. An empty table gives no rows. Other columns of the inputs, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bound_batches, byte_set, materialize, sized, slices, utf8, word_hashes, word_spans

STATISTICS = ("bytes", "words", "word_bytes", "capitals", "capital_words", "digits", "signs", "sign_words", "stops", "repeats", "distinct", "lines", "line_words", "top_word", "wide")
#: Cuts of a statistic: these quantiles of all documents.
QUANTILES = (0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99)
CUTS = len(QUANTILES)
SIZE = len(STATISTICS) * CUTS + 1
HALF = np.triu_indices(SIZE)
#: Ridge on the weights, over the root of the number of positives.
RIDGE = 0.1
#: Newton steps at most, the longest, and what is near enough.
STEPS, LONGEST, NEAR = 30, 4.0, 0.02
#: Scores are counted in so many cells for the prior, with bounds that hold with this probability.
CELLS, CHANCE = 1000, 0.05
#: A document is predicted 1 from this score on.
LEAST = 0.3
_UPPER, _LOWER, _DIGIT = byte_set((65, 90)), byte_set((97, 122)), byte_set((48, 57))
_STOP = byte_set(*((ord(c), ord(c)) for c in ".,;:?'\"()-"))
_WIDE = byte_set((0x80, 0xFF))
_SIGN = ~(_UPPER | _LOWER | _DIGIT | _STOP | _WIDE | SPACE)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATISTICS of each text, one row a text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    starts, ends, row = word_spans(data, offsets)
    words = np.bincount(row, minlength=n)

    def of_bytes(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        return total[offsets[1:]] - total[offsets[:-1]]

    def of_words(mark: np.ndarray) -> np.ndarray:
        return np.bincount(row, mark, minlength=n)

    first, last = (data[starts], data[ends - 1]) if len(starts) else (np.zeros(0, np.uint8),) * 2
    letters_in = np.concatenate(([0], np.cumsum(_LOWER[data], dtype=np.int64)))
    capital = _UPPER[first] & (letters_in[ends] == letters_in[starts]) & (ends - starts > 1)
    hashes = word_hashes(data, starts, ends, lower=True)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    by = np.lexsort((hashes, row))
    new = np.ones(len(by), bool)
    new[1:] = (hashes[by][1:] != hashes[by][:-1]) | (row[by][1:] != row[by][:-1])
    runs = np.diff(np.concatenate((np.flatnonzero(new), [len(by)])))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, row[by][new], runs)
    lines = of_bytes(byte_set((10, 10))) + (size > 0)
    per = lambda x, y: x / np.maximum(y, 1)
    return np.stack(
        [
            size, words, per(size, words), per(of_bytes(_UPPER), size), per(of_words(capital), words), per(of_bytes(_DIGIT), size), per(of_bytes(_SIGN), size),
            per(of_words(_SIGN[first] | _SIGN[last]), words), per(of_bytes(_STOP), words), per(of_words(again), words), per(np.bincount(row[by][new], minlength=n), np.sqrt(words)),
            lines, per(words, lines), per(top, words), per(of_bytes(_WIDE), size),
        ],
        1,
    )


def measure(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """keep and the statistics s0, s1, ... of each text."""
    names = [f"s{i}" for i in range(len(STATISTICS))]

    def work(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(len(keep)))
            for i, j in slices(offsets):
                found = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                kept = [c.slice(i, j - i) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(found[:, k].astype(np.float64)) for k in range(found.shape[1]))], [*keep, *names])

    schema = docs.select(*keep).schema.simpleString()[7:-1]
    return bound_batches(docs).select(*keep, "text").mapInArrow(work, ", ".join([schema, *(f"{x} double" for x in names)]))


@dataclass
class QualityModel:
    """edges[statistic]: cuts between its bins; weights of all bins, the constant last; prior: the share of positives."""

    edges: list[np.ndarray]
    weights: np.ndarray
    prior: float

    def bins(self, values: np.ndarray) -> np.ndarray:
        """The number of cuts below each of the statistics."""
        return np.stack([np.searchsorted(e, values[:, k], "left") for k, e in enumerate(self.edges)], 1)


def logistic(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -500, 500)))


def features(bins: np.ndarray) -> np.ndarray:
    """A column for each cut, 1 where the statistic is above it, so that neighbouring bins have most of their weight in common; and the constant."""
    x = (bins[:, :, None] > np.arange(CUTS)).reshape(len(bins), -1)
    return np.hstack((x, np.ones((len(bins), 1)))).astype(np.float64)


@dataclass
class Risk:
    """prior * P[l(g)] + share * N, where N = A[l(-g)] - prior * P[l(-g)] is the negatives' risk, over the positives P and all A, with l the logistic loss."""

    prior: float
    n: int
    n_positive: int
    share: float = 1.0

    def sums(self, x: np.ndarray, positive: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What a slice of rows adds to A and P of the logistic times the features, to the upper half of the curvature, and to N."""
        g = x @ weights
        p = logistic(g)
        curve = x.T @ (x * (p * (1 - p) * (self.share / self.n + positive * (1 - self.share) * self.prior / self.n_positive))[:, None])
        negative = np.logaddexp(0, g).sum() / self.n - self.prior * np.logaddexp(0, g[positive]).sum() / self.n_positive
        return np.concatenate((x.T @ p / self.n, x[positive].T @ p[positive] / self.n_positive, curve[HALF], [negative]))


def _added(bins: DataFrame, size: int, part) -> np.ndarray:
    """The sum over all rows of what part gives for slices of rows: their features, which are positive, and a half of these."""

    def work(batches):
        total = np.zeros(size)
        for batch in batches:
            own = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            positive, half = (np.asarray(batch.column(c)).astype(bool) for c in (0, 1))
            for i in range(0, len(own), 4096):
                some = slice(i, i + 4096)
                total += part(features(own[some]), positive[some], half[some])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "value"])

    out = np.zeros(size)
    for place, value in bins.select("positive", "half", "bins").mapInArrow(work, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():  # size rows
        out[place] = value
    return out


def minimise(add, risk: Risk, mean: np.ndarray) -> np.ndarray:
    """Weights with the least non-negative risk; add gives the sums of a risk at some weights, mean is that of the positives' features.

    prior * P[l(g)] + max(0, N) is the greatest of the risks of all shares from 0 to 1, each of which is convex in g, so that its least is a saddle
    point: the share is 1 where N isn't below 0 there, else N is 0. Newton steps of weights and share together find it.
    """
    ridge = np.full(SIZE, RIDGE / np.sqrt(risk.n_positive))
    ridge[-1] = 1e-6
    weights, prior = np.zeros(SIZE), risk.prior
    for _ in range(STEPS):
        total, share = add(risk, weights), risk.share
        of_all, of_positive, negative = total[:SIZE], total[SIZE : 2 * SIZE], total[-1]
        curve = np.zeros((SIZE, SIZE))
        curve[HALF] = total[2 * SIZE : -1]
        curve = np.maximum(curve, curve.T) + np.diag(ridge)
        slope = of_all - prior * of_positive  # of N
        gradient = share * (of_all - prior * mean) + (1 - share) * prior * (of_positive - mean) + ridge * weights
        step, turn = -np.linalg.solve(curve, np.stack((gradient, slope), 1)).T
        if share < 1 or negative < 0:
            more = np.clip(share - (negative + slope @ step) / min(slope @ turn, -1e-12), 0, 1) - share
            step = step + more * turn
        else:
            more = 0.0
        longest = np.abs(step).max()
        if longest < NEAR and abs(more) < NEAR:
            break
        part = min(1, LONGEST / max(longest, 1e-12))
        weights, risk = weights + part * step, replace(risk, share=share + part * more)
    return weights


def estimated_prior(counts: np.ndarray, positives: np.ndarray) -> float:
    """A lower bound of the share of positives from counts of all documents and of positives by score: too great a prior makes all look positive.

    Taken at the score from which on the upper bound of the ratio of both shares is least.
    """
    n, n_positive = counts.sum(), positives.sum()
    all_above, positive_above = counts[::-1].cumsum() / n, positives[::-1].cumsum() / n_positive
    slack = np.sqrt(np.log(4 / CHANCE) / (2 * n)) + np.sqrt(np.log(4 / CHANCE) / (2 * n_positive))
    some = positive_above > 0
    best = ((all_above[some] + slack) / positive_above[some]).argmin()
    return float(np.clip((all_above[some][best] - slack) / positive_above[some][best], 0.05, 0.99))


@dataclass
class Fitted:
    """The statistics of all documents, as written, and the model; None where there is no positive."""

    table: DataFrame
    model: QualityModel | None


def fit(docs: DataFrame, positives: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> Fitted:
    """Learn from all texts of docs and from which of them are trusted positives (doc_id)."""
    table = materialize(measure(docs, keep), "statistics")
    names = [f"s{i}" for i in range(len(STATISTICS))]
    trusted = sized(materialize(positives.select("doc_id").distinct().withColumn("positive", F.lit(True)), "positives"))
    half = F.coalesce(F.col("positive") & (F.xxhash64("doc_id") % 2 == 0), F.lit(False))
    marked = table.join(trusted, "doc_id", "left").select(F.coalesce("positive", F.lit(False)).alias("positive"), half.alias("half"), *names)
    cuts = table.approxQuantile(names, list(QUANTILES), 0.002) if table.limit(1).count() else []
    model = QualityModel([np.array(c) for c in cuts], np.zeros(SIZE), 0.5)

    def place(batches):
        for batch in batches:
            own = model.bins(np.stack([np.asarray(c) for c in batch.columns[2:]], 1))
            cut = pa.array(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(cut, pa.array(own.ravel().astype(np.int8)))], ["positive", "half", "bins"])

    bins = materialize(marked.mapInArrow(place, "positive boolean, half boolean, bins array<tinyint>"), "bins")
    n, n_positive = bins.agg(F.count("*"), F.count_if("positive")).first()
    if not n_positive:
        return Fitted(table, None)
    add = lambda risk, weights: _added(bins, 2 * SIZE + len(HALF[0]) + 1, lambda x, positive, half: risk.sums(x, positive, weights))
    means = _added(bins, 2 * SIZE, lambda x, positive, half: np.concatenate((x[half].sum(0), x[positive].sum(0)))).reshape(2, SIZE)
    n_half = int(means[0, -1])  # the constant
    if n_half and n_half < n_positive:
        half_only = lambda risk, weights: _added(bins, 2 * SIZE + len(HALF[0]) + 1, lambda x, positive, half: risk.sums(x, half, weights))
        first = minimise(half_only, Risk(0.5, n, n_half), means[0] / n_half)
        cell = lambda g: np.bincount(np.minimum((logistic(g) * CELLS).astype(int), CELLS - 1), minlength=CELLS)
        counts = _added(bins, 2 * CELLS, lambda x, positive, half: np.concatenate((cell(x @ first), cell(x[positive & ~half] @ first))))
        model.prior = estimated_prior(counts[:CELLS], counts[CELLS:])
    model.weights = minimise(add, Risk(model.prior, n, n_positive), means[1] / n_positive)
    return Fitted(table, model)


def scores(fitted: Fitted, keep: tuple[str, ...]) -> DataFrame:
    """keep and the score of each document."""
    model = fitted.model
    if model is None:
        return fitted.table.select(*keep, F.lit(0.5).alias("score"))

    def work(batches):
        for batch in batches:
            own = model.bins(np.stack([np.asarray(c) for c in batch.columns[len(keep) :]], 1))
            found = [logistic(features(own[i : i + 4096]) @ model.weights) for i in range(0, len(own), 4096)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(found or [np.zeros(0)]))], [*keep, "score"])

    schema = fitted.table.select(*keep).schema.simpleString()[7:-1]
    return fitted.table.select(*keep, *(f"s{i}" for i in range(len(STATISTICS)))).mapInArrow(work, f"{schema}, score double")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from the positive labels that aren't held out."""
    positives = labels.filter((F.col("quality") == 1) & ~held_out()).select("doc_id")
    fitted = fit(docs.select("doc_id", "text"), positives)
    return scores(fitted, ("doc_id",)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))
