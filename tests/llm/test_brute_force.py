"""Whole queries against plain versions: language identification row by row, recall of near duplicates, archives with clashing columns."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from sparkguard.llm import langid, near_dedup, warc


def plain_label(text, model, penalty=langid.SWITCH_PENALTY):
    """(lang_pred, score, spans) of one text, word by word; every path of labels by its best last step."""
    if not text or not any(unicodedata.category(c)[0] == "L" for c in text):
        return "und", 0.0, None
    scores, weights = [], []
    for word in text.encode().split():
        total, letters, script = np.zeros(len(model.labels)), 0, 0
        kinds, low = langid.byte_scripts(np.frombuffer(word, np.uint8)), bytes(b + 32 if 65 <= b <= 90 else b for b in word)
        for i, kind in enumerate(kinds):
            script = max(script, int(kind))
            if kind:
                a, b, c = low[i], low[i - 1] if i else 32, low[i - 2] if i > 1 else 32
                bucket = ((a | b << 8 | c << 16) * 2654435761 & 0xFFFFFFFF) >> 17
                total += model.table[max(bucket, 1)]
                letters += 1
        scores.append([s if ok else s - 1000 for s, ok in zip(total, model.allowed[script], strict=True)])
        weights.append(letters)
    paths = [(s, [k]) for k, s in enumerate(scores[0])]
    for row in scores[1:]:
        paths = [max(((p[0] - (p[1][-1] != k) * penalty + s, [*p[1], k]) for p in paths), key=lambda x: x[0]) for k, s in enumerate(row)]
    best = max(paths, key=lambda x: x[0])[1]
    share = [sum(w for w, k in zip(weights, best, strict=True) if k == lang) for lang in range(len(model.labels))]
    top = max(range(len(share)), key=lambda k: share[k])
    spans = []
    for i, k in enumerate(best):
        if spans and spans[-1][2] == model.labels[k]:
            spans[-1] = (spans[-1][0], i + 1, model.labels[k])
        else:
            spans.append((i, i + 1, model.labels[k]))
    return model.labels[top], share[top] / max(sum(weights), 1), spans


def test_language_of_every_row(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    r = random.Random(2)
    texts = {row.doc_id: row.text for row in docs.collect()}
    mixed = [(10_000 + i, " ".join(w for t in r.sample(sorted(texts.values()), 3) for w in t.split()[:40]), None) for i in range(20)] + [(20_000, None, None), (20_001, "12 !", None), (20_002, "Ꭳ ᏣᎳᎩ the", None), (20_003, "Ünï😀x ß", None)]
    every = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(mixed, "doc_id long, text string, lang string"))
    model = langid.train(every.filter(~langid.held_out()))
    got = {x.doc_id: x for x in langid.identify(every).collect()}
    assert len(got) == 84
    for i, text in {**texts, **{i: t for i, t, _ in mixed}}.items():
        pred, score, spans = plain_label(text, model)
        assert (got[i].lang_pred, got[i].score) == (pred, pytest.approx(score)), i
        if spans is not None:
            assert [tuple(s) for s in got[i].spans] == spans, i


def test_recall_of_near_duplicates(spark):
    """Measured on pairs just above the threshold, short texts above all; each pair is a class of its own."""
    r, rows, n = random.Random(9), [], 600
    for i in range(n):
        size = r.choice([8, 9, 12, 15, 20, 30, 60, 120])
        base = [f"p{i}w{r.randrange(10**6)}" for _ in range(size)]
        other = base + [f"p{i}more"] * max(1, (size - 4) // 5) if r.random() < 0.5 else base[max(1, (size - 4) // 6) :]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    grams = near_dedup._shingles_of(pa.array([t for _, t in rows]))
    alike = {i for i in range(n) if near_dedup.similarity(grams[2 * i], grams[2 * i + 1]) >= 0.8}
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {i for i in range(n) if got[2 * i + 1] == 2 * i}
    assert len(alike) > 300 and found <= alike and len(found) / len(alike) >= 0.99


def test_round_trip_with_clashing_columns_and_ties(spark):
    html = "<p>" + "x" * 2000
    rows = [(1, "u", html, "a", 1), (7, "u", html, "b", 2), (7, "u", html, "b", 2), (3, "u", "short", "c", 3), (4, "u", "short", "c", 3), (5, "u", None, "d", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, n int").withColumnRenamed("n", "payload")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert [g for g in got if g[0] != 7] == [(1, 2003, "revisit", 7), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None)]
    assert {g[0] for g in got} == {1, 3, 4, 5, 7} and sum(g[2] == "response" for g in got if g[0] == 7) >= 1
