"""Dual-tree search against a plain ranking."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkguard.llm import lexical_search as ls

DOCS, ITEMS = "doc_id long, text string, item string, term int", "item_id long, text string, rank string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=50):
    words = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(w) for _, w in words), sum(sum(w.values()) for _, w in words)
    df = Counter(t for _, w in words for t in w)
    of_item = {}
    for i, t in items:
        of_item.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in of_item.items():
        found = []
        for i, w in words:
            m = 50 + 50 * sum(w.values()) * n_docs // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 20 * m)) for t in wanted if t in w)
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(map(str, out))


def corpus(n, seed, vocabulary=300):
    r = random.Random(seed)
    return [(i, " ".join(f"W{min(int(r.paretovariate(0.6)), vocabulary)}x{r.randrange(2)}" for _ in range(r.randrange(1, 120)))) for i in range(n)]


ODD = [(None, None), (None, "w1x1 w2x1"), (None, "w1x1 w2x1"), (5000, ""), (5001, " \n!?"), (5002, "Ünï É w3x0 é"), (5002, "w3x0"), (5003, "w1x0 " * 20_000), (5004, "w7x1 rare-word"), (5004, "w7x1 rare-word")]


def run(spark, docs, items, k=50):
    got = ls.search(spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS).repartition(3), spark.createDataFrame([(*i, "x") for i in items], ITEMS), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(str(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("k", [3, 50])
def test_equals_a_plain_ranking(spark, k):
    docs = corpus(500, 1) + [(9000 + i, "w1x0 w2x0 w5x1 same") for i in range(120)] + ODD
    items = corpus(30, 2) + [(100, None), (101, ""), (102, "nowhere-at-all"), (103, "same RARE word"), (103, "ünï"), (104, "Ünï É"), (None, "w9x1 w4x0"), (105, "w1x0")]
    assert run(spark, docs, items, k) == plain(docs, items, k)


def test_empty_tables(spark):
    assert run(spark, [], corpus(3, 1)) == [] and run(spark, corpus(3, 1), []) == [] and run(spark, [(1, None)], [(1, "a")]) == []


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ls, "MAX_TERMS", 40)
    docs, items = corpus(60, 3), corpus(12, 4)
    assert run(spark, docs, items, 5) == plain(docs, items, 5)


def test_bounds_prune_whole_batches():
    """Two languages that share no word: half of the pairs go by the bounds of large nodes, and more within a language."""
    r = np.random.default_rng(1)
    n, size = 4096, 400
    lang = np.arange(n) % 2
    counts = np.full(n, 12)
    term = np.concatenate([np.sort(r.choice(200, 12, replace=False)) + 200 * x for x in lang])
    tf, weight = np.ones(len(term), np.int64), r.integers(100, 9000, size)
    terms_ = [np.sort(r.choice(200, 6, replace=False)) + 200 * (i % 2) for i in range(32)]
    tree = ls.ItemTree.build(list(range(32)), terms_, weight)
    search = ls.Search(tree, 10, np.zeros(32, np.int64))
    length = np.full(n, 12)
    ls.search_batch(search, weight, tree.nodes(2), np.arange(n), length, counts, term, tf, n, 12 * n)
    value = ls.parts(weight, term, tf, np.full(len(term), 12), n, 12 * n)
    dense = np.zeros((n, size), np.int64)
    dense[np.repeat(np.arange(n), 12), term] = value
    for i in range(32):
        scores = dense[:, tree.terms[i]].sum(1)
        want = np.lexsort((np.arange(n), -scores))[:10]
        assert search.ids[i].tolist() == want.tolist() and search.scores[i].tolist() == scores[want].tolist()
    assert search.pairs == 32 * n and search.scored < 0.45 * search.pairs


def test_pruning_report(spark):
    docs = spark.createDataFrame([(*d, "x", 1) for d in corpus(400, 1)], DOCS)
    row = ls.pruning(docs, spark.createDataFrame([(*i, "x") for i in corpus(10, 2)], ITEMS), 3).first()
    assert row.pairs == 4000 and 0 < row.scored < 4000
