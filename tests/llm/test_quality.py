"""The quality classifier: its risk, its prior, what it learns from, and accuracy on labels that it never saw."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkguard.llm import quality as q
from sparkguard.llm.common import utf8

DOCS, LABELS = "doc_id long, text string, score string, s0 int", "doc_id long, quality int, toxic int"


def clean(r, n):
    return " ".join(r.choice(["one", "two", "stone", "river", "light", "paper", "green"]) + str(r.integers(40)) * (r.random() < 0.1) for _ in range(n)) + "."


def junk(r, n):
    return " ".join(r.choice(["BUY", "NOW", "FREE"]) + "!!" for _ in range(n)) if r.random() < 0.5 else " ".join(["same"] * n)


def corpus(n, seed=1, share=0.8):
    r = np.random.default_rng(seed)
    good = r.random(n) < share
    return [(i, clean(r, r.integers(20, 200)) if g else junk(r, r.integers(20, 200))) for i, g in enumerate(good)], good


def test_statistics():
    texts = ["", None, "AB ab!! ab!!\nab ü9 ", "x" * 5000]
    data, offsets = utf8(pa.array(texts, pa.string()))
    found = [dict(zip(q.STATISTICS, row, strict=True)) for row in q.statistics(data, offsets)]
    assert set(found[0].values()) == {0} and found[0] == found[1]
    a = found[2]
    assert (a["bytes"], a["words"], a["lines"], a["line_words"], a["capital_words"], a["digits"]) == (20, 5, 2, 2.5, 0.2, 0.05)
    assert (a["sign_words"], a["repeats"], a["top_word"], a["capitals"], a["signs"], a["wide"]) == (0.4, 0.2, 0.4, 0.1, 0.2, 0.1)
    assert (found[3]["words"], found[3]["top_word"]) == (1, 1)


def design(n=4000, seed=3):
    r = np.random.default_rng(seed)
    x = np.zeros((n, q.SIZE))
    x[:, :6] = r.random((n, 6)) < 0.4
    x[:, -1] = 1
    truth = r.random(n) < 1 / (1 + np.exp(-(x[:, :6] @ [3, -3, 2, -2, 1, 0.5] + 0.5)))
    return x, truth, truth & (r.random(n) < 0.5)


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.95])
def test_least_non_negative_risk(prior):
    x, _, positive = design()
    n, n_positive = len(x), int(positive.sum())
    ridge = q.RIDGE / np.sqrt(n_positive)

    def risk(w):
        g = x @ w
        negative = np.logaddexp(0, g).mean() - prior * np.logaddexp(0, g[positive]).mean()
        return prior * np.logaddexp(0, -g[positive]).mean() + max(0, negative) + ridge * (w[:-1] ** 2).sum() / 2, negative

    found = q.minimise(lambda r, w: r.sums(x, positive, w), q.Risk(prior, n, n_positive), x[positive].mean(0))
    least, negative = risk(found)
    assert negative > -0.02
    r = np.random.default_rng(0)
    for size in (0.3, 0.05, 0.01):
        for _ in range(200):
            step = np.zeros(q.SIZE)
            step[[*range(6), -1]] = r.normal(size=7) * size
            assert risk(found + step)[0] > least - 2e-3


def test_prior():
    r = np.random.default_rng(2)
    positives, negatives = r.beta(5, 2, 40_000), r.beta(2, 8, 10_000)
    cell = lambda v: np.bincount((v * q.CELLS).astype(int), minlength=q.CELLS)
    assert 0.75 < q.estimated_prior(cell(np.concatenate((positives, negatives))), cell(positives[:20_000])) < 0.81


def test_learns_from_positives_and_unlabelled(spark):
    rows, good = corpus(1500)
    docs = spark.createDataFrame([(*d, "x", 1) for d in rows], DOCS).repartition(4)
    labels = [(i, int(good[i]), 0) for i in range(0, 1500, 2)]
    got = {r.doc_id: r for r in q.classify(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert len(got) == 1500 and np.mean([(got[i].predicted == 1) == g for i, g in enumerate(good)]) > 0.97
    held = {r.doc_id for r in docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()}
    assert {i for i, r in got.items() if r.held_out} == held and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    # labels that are held out, or 0, change nothing
    other = [(i, 1 - v if i in held else v, 1) for i, v, _ in labels if v or i in held]
    again = {r.doc_id: r.score for r in q.classify(docs, spark.createDataFrame(other, LABELS)).collect()}
    assert max(abs(again[i] - r.score) for i, r in got.items()) < 1e-6


def test_odd_rows(spark):
    rows, good = corpus(200)
    odd = [(None, None), (None, "a"), (900, None), (900, ""), (901, "x" * 300_000), (902, rows[0][1]), (902, rows[0][1]), (903, "中文")]
    docs = spark.createDataFrame([(*d, "x", 1) for d in rows + odd], DOCS)
    labels = spark.createDataFrame([(i, 1, None) for i in range(200) if good[i]] + [(None, 1, 0), (5, None, 0), (1, 1, 0), (1, 0, 0)], LABELS)
    got = q.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == 208 and all(r.score is not None and r.held_out is not None for r in found)
    of = lambda i: {r.score for r in found if r.doc_id == i}
    assert len(of(902) | of(0)) == 1 and len(of(900)) == 1
    none = q.classify(docs, spark.createDataFrame([(1, 0, 0)], LABELS))
    assert {(r.score, r.predicted) for r in none.collect()} == {(0.5, 1)}
    assert q.classify(docs.limit(0), labels).count() == 0 and q.classify(docs.limit(0), labels.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = q.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet").dropDuplicates(["doc_id"]), "doc_id").filter("held_out").toPandas()
    low, high = rows[rows.quality == 0].score.to_numpy(), rows[rows.quality == 1].score.to_numpy()
    assert (high[:, None] > low).mean() > 0.97 and (rows.predicted == rows.quality).mean() > 0.9
