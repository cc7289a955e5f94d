"""The pipeline's stages on a small corpus, and its queries against SQL."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkguard.llm import langid, queries
from tests.oracle import canonical, connect

from .test_operators import words


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    assert canonical(queries.QUERIES[name](spark, sf).toPandas()) == canonical(connect(sf).sql(queries.ORACLE_SQL[name]).df())


def test_stages(spark, tmp_path):
    item = " ".join(words(30, 9))
    base = " ".join(words(200, 1))
    secret = 'token = "0123456789abcdef0123456789abcdef01234567"'
    rows = [(1, base), (2, base), (3, base + " more"), (4, "123"), (5, None), (6, " ".join(words(50, 2)) + " " + item), (7, " ".join(words(80, 3)) + " " + secret), (8, " ".join(words(90, 4))), (8, " ".join(words(90, 4)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {"language_id": [1, 2, 3, 6, 7, 8, 8], "near_dedup": [1, 6, 7, 8], "decontamination": [1, 7, 8], "secrets": [1, 7, 8], "packing": [1, 7, 8]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).cache()
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == want[name]
        assert name == "packing" or (out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString())
        docs = out
        if name == "secrets":
            hidden = out.filter("doc_id = 7").first()
            assert "0123456789abcdef" not in hidden.text and hidden.n_chars == len(hidden.text)


def test_language_stage_decides_by_spans(spark, tmp_path):
    r = random.Random(1)
    lexicon = {"en": ["the", "house", "with", "there", "thing"], "it": ["della", "casa", "perché", "zione", "quello"], "ru": ["слово", "дом", "когда", "человек"]}
    text = lambda k, n: " ".join(r.choice(lexicon[k]) for _ in range(n))
    rows = [(i, text(k, 60), k) for i, k in enumerate(["en", "it", "ru"] * 20)]
    rows += [(100, text("en", 40) + " " + text("it", 35) + " " + text("ru", 15), None), (101, text("en", 40) + " " + text("it", 10), None), (102, "12 !", None), (103, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = lambda d: {x.doc_id for x in corpus_pipeline.identify_language(spark, d, str(tmp_path)).collect()}
    # 100 has letters, but no language that holds half of them
    assert kept(docs) == {*range(60), 101}
    # nothing to learn from: no label at all, or only in held-out rows
    assert kept(docs.withColumn("lang", F.lit(None).cast("string"))) == {*range(60), 100, 101}
    assert kept(docs.withColumn("lang", F.when(langid.held_out(), F.col("lang")))) == {*range(60), 100, 101}


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids, shared ids, clashing and map columns, empty tables."""
    item, base, unlike = (" ".join(words(n, k)) for n, k in ((30, 9), (120, 1), (90, 2)))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, base), (1, unlike), (1, base), (2, base), (None, base), (None, unlike + " " + item), (3, None), (4, ""), (5, item + " " + unlike), (5, " ".join(words(70, 5)))]
    schema = "doc_id long, text string, lang string, n_chars int, score double, spans map<string,int>, label string, keep string, node long, class_id int, tag string, item_id string"
    docs = spark.createDataFrame([(i, t, None, len(t or ""), 0.5, {"a": 1}, "l", "k", 7, 8, "t", "x") for i, t in rows], schema)
    kept = lambda name, d: sorted((r.doc_id or 0, r.text or "") for r in dict(corpus_pipeline.STAGES)[name](spark, d, str(tmp_path)).collect())
    text = lambda r: (r[0] or 0, r[1] or "")
    assert kept("language_id", docs) == sorted(text(r) for r in rows if r[1])
    # 2 is a copy of 1; 1 keeps both of its texts, one row each
    assert kept("near_dedup", docs) == sorted([text(r) for i, r in enumerate(rows) if i not in (2, 3)])
    assert kept("decontamination", docs) == sorted(text(r) for r in rows if item not in (r[1] or ""))
    assert kept("secrets", docs) == sorted(map(text, rows))
    packed = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))
    assert packed.count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_equals_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns)
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
