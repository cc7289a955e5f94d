"""Corpora: integrity faults, spans, totals, files, index state and retrieval measures."""

import random

import pytest
from pyspark.sql import functions as F

from sparkguard import schemas as S
from sparkguard.operators import corpus as K
from sparkguard.operators import decisions, fingerprints, keywords, retrieval, scans
from sparkguard.sources import corpus as files
from sparkguard.sources import relational, versions

TRUTH = "document_id string, client_id string, pair_id string, variant string"


@pytest.fixture
def tables(spark):
    c = spark.createDataFrame
    return {
        "clients": c([("C1", "Acme", "PL", "x"), ("C2", "Beta", "US", "y")], S.CLIENTS),
        "contacts": c([("K1", "C1", "A", "a@x.example", "1", "PESEL", "44051401359")], S.CONTACTS),
        "accounts": c([("A1", "C1", "PL61", "PLN", 1000), ("A2", "C2", "US", "USD", 0)], S.ACCOUNTS),
        "transactions": c([("T1", "A1", "C1", "z", 500, "PLN", "credit", "settled", None, "r"), ("T2", "A1", "C1", "z", 200, "PLN", "debit", "settled", None, "r"), ("T3", "A2", "C2", "z", 70, "USD", "debit", "pending", None, "r")], S.TRANSACTIONS),
        "documents": c([("D1", "C1", "t", "note", "internal", "s", None, ["T1"]), ("D2", "C1", "t", "note", "internal", "s", None, []), ("D3", None, "g", "guide", "public", "s", None, [])], S.DOCUMENTS),
        "truth": c([("D1", "C1", "P", "clean"), ("D2", "C1", "P", "poisoned"), ("D3", None, None, "clean")], TRUTH),
        "questions": c([("Q1", "C1", ["D1"])], "question_id string, client_id string, relevant_document_ids array<string>"),
    }


def test_sound_corpus(tables):
    assert K.validate_corpus(tables).count() == 0


@pytest.mark.parametrize(
    ("table", "change", "problem"),
    [
        ("transactions", {"currency": "'EUR'"}, "payment does not fit account"),
        ("transactions", {"client_id": "'C9'"}, "payment without client"),
        ("documents", {"client_id": "'C2'"}, "link does not fit payment"),
        ("truth", {"variant": "'clean'"}, "incomplete pair"),
        ("questions", {"relevant_document_ids": "array('D8')"}, "question target without document"),
        ("contacts", {"client_id": "'C7'"}, "contact without client"),
        ("clients", {"client_id": "'C1'"}, "duplicate client"),
    ],
)
def test_faults_are_found(tables, table, change, problem):
    changed = {**tables, table: tables[table].withColumns({k: F.expr(v) for k, v in change.items()})}
    assert problem in {r.problem for r in K.validate_corpus(changed).collect()}


def test_totals_and_liquidity(tables):
    assert {tuple(r) for r in K.payment_totals(tables["transactions"]).collect()} == {("PLN", 2, 500, 200), ("USD", 1, 0, 70)}
    assert {tuple(r) for r in K.liquidity(tables["accounts"], tables["transactions"]).collect()} == {("A1", "PLN", 1300), ("A2", "USD", 0)}
    assert [r.client_id for r in K.find_clients(tables["clients"], name="ACM").collect()] == ["C1"]


def test_spans(spark):
    docs = spark.createDataFrame([("D1", "é aa aa b"), ("D2", None)], "document_id string, text string")
    found = K.annotate_spans(docs, spark.createDataFrame([("D1", "x", "aa"), ("D1", "y", "é")], "document_id string, kind string, value string"))
    spans = found.select("document_id", F.inline("spans"))
    assert [(r.kind, r.start, r.end) for r in spans.collect()] == [("y", 0, 1), ("x", 2, 4), ("x", 5, 7)]
    assert K.check_spans(docs, spans).count() == 0
    assert K.check_spans(docs, spans.withColumn("start", F.col("start") + 1)).count() == 3
    hit = spans.select("document_id", F.lit("pii").alias("kind"), "start", "end").filter("start > 0")
    report = {r.kind: (r.spans, r.covered) for r in K.detection_report(hit, spans.drop("value")).collect()}
    assert report == {"x": (2, 2), "y": (1, 0)}
    flags = spark.createDataFrame([("D1", True)], "document_id string, flagged boolean")
    assert {r.variant: (r.documents, r.flagged) for r in K.flag_report(flags, spark.createDataFrame([("D1", "", "", "poisoned"), ("D2", "", "", "clean")], TRUTH)).collect()} == {"poisoned": (1, 1), "clean": (1, 0)}


def test_files_round_trip(spark, tmp_path, tables):
    docs = tables["documents"].withColumn("text", F.concat(F.lit("# "), "document_id"))
    manifest = files.export_corpus({"clients": tables["clients"], "documents": docs}, str(tmp_path / "out"))
    assert {r.table: r.rows for r in manifest.collect()} == {"clients": 2, "documents": 3}
    root = tmp_path / "in"
    for name in files.TABLES:
        tables[name].write.json(str(root / name))
    tables["documents"].withColumn("path", F.concat("document_id", F.lit(".md"))).write.json(str(root / "documents"))
    (root / "bodies").mkdir()
    for i in (1, 2, 3):
        (root / "bodies" / f"D{i}.md").write_text(f"# D{i}\nbody")
    back = files.read_corpus(spark, str(root))
    assert {r.document_id: r.text for r in back["documents"].collect()} == {f"D{i}": f"# D{i}\nbody" for i in (1, 2, 3)}
    assert K.table_differences(back["clients"], tables["clients"]).count() == 0


IDENTITY = {"model": "m", "revision": "1", "dimensions": 2, "max_tokens": 100, "chunker": "c"}


def test_index_plan(spark, tmp_path):
    docs = spark.createDataFrame([("D1", "t", "# A\nabout contact"), ("D2", "t", "other")], "document_id string, title string, text string")
    chunks = retrieval.chunk(docs, len, 100)
    vectors = retrieval.embed(chunks, lambda texts: [[1.0, 0.0] if "contact" in t else [0.0, 1.0] for t in texts], 2).cache()
    assert vectors.filter("problem IS NOT NULL").count() == 0 and vectors.count() == 2
    mark = retrieval.source_fingerprint(docs).first().fingerprint
    assert mark == retrieval.source_fingerprint(docs.repartition(3)).first().fingerprint
    assert mark != retrieval.source_fingerprint(docs.limit(1)).first().fingerprint
    state = spark.createDataFrame([{**IDENTITY, "fingerprint": mark, "rows": 2}])
    assert retrieval.plan_index(chunks, vectors, state, IDENTITY, mark)[0] == "reuse"
    kind, todo = retrieval.plan_index(chunks, vectors.limit(1), state, IDENTITY, "changed")
    assert (kind, todo.count()) == ("embed", 1)
    assert retrieval.plan_index(chunks, vectors, None, IDENTITY, mark)[0] == retrieval.plan_index(chunks, vectors, state, {**IDENTITY, "revision": "2"}, mark)[0] == "rebuild"
    retrieval.assert_fresh(state, IDENTITY, mark)
    with pytest.raises(ValueError, match="stale"):
        retrieval.assert_fresh(state, IDENTITY, "other")
    retrieval.write_index(vectors, state, str(tmp_path / "index"), "v1")
    stored, kept = retrieval.read_index(spark, str(tmp_path / "index"))
    assert kept.first().version == "v1" and stored.count() == vectors.count()
    retrieval.assert_fresh(kept, IDENTITY, mark)


def test_scoped_search(spark):
    docs = spark.createDataFrame([("D1", "C1", "internal"), ("D2", "C2", "internal"), ("D3", None, "public"), ("D4", None, "internal")], "document_id string, client_id string, classification string")
    chunks = spark.createDataFrame([(f"D{i}", f"D{i}#0", [1.0, float(i)], f"word{i} shared text") for i in range(1, 5)], "document_id string, chunk_id string, embedding array<float>, text string")
    scope = retrieval.visible(chunks, docs, "C1")
    assert {r.document_id for r in scope.collect()} == {"D1", "D3"}
    links = spark.createDataFrame([("D3", "T1")], "document_id string, transaction_id string")
    assert [h.document_id for h in retrieval.search(scope, [1.0, 0.0], 5, links, "T1").collect()] == ["D3"]
    with pytest.raises(ValueError, match="k must"):
        retrieval.search(scope, [1.0, 0.0], 11)
    found = retrieval.keyword_search(scope, "Shared word3, an", 2).collect()
    assert [(r.chunk_id, r.score) for r in found] == [("D3#0", 0.8165), ("D1#0", 0.4082)]
    hits = spark.createDataFrame([("Q1", "D1", "D1#0", 1, 0.9, "a"), ("Q1", "D3", "D3#0", 2, 0.8, "b"), ("Q2", "D2", "D2#0", 1, 0.7, "c")], "question_id string, document_id string, chunk_id string, rank int, similarity double, text string")
    questions = spark.createDataFrame([("Q1", ["D1", "D9"]), ("Q2", ["D1"]), ("Q3", ["D1"])], "question_id string, relevant_document_ids array<string>")
    assert {r.question_id: r.recall for r in retrieval.recall_at_k(hits, questions, 2).collect()} == {"Q1": 0.5, "Q2": 0.0, "Q3": 0.0}
    text = {r.question_id: r.result for r in retrieval.render_hits(hits, "question_id").collect()}["Q1"]
    assert text == 'Source: {"document_id":"D1","chunk_id":"D1#0","similarity":0.9}\na\n\nSource: {"document_id":"D3","chunk_id":"D3#0","similarity":0.8}\nb'
    assert {r.question_id: r.sources for r in retrieval.hit_sources(hits, "question_id").collect()} == {"Q1": ["D1", "D3"], "Q2": ["D2"]}


def test_conformance_and_effect(spark):
    schema = "case string, action string, blocked_by string, reason string"
    got = spark.createDataFrame([("a", "block", "budget", "too many"), ("b", "allow", None, "")], schema)
    want = spark.createDataFrame([("a", "block", "loops", "many"), ("c", "allow", None, None)], "case string, action string, blocked_by string, reason_contains string")
    assert {r.case: r.differs for r in decisions.conformance(got, want).collect()} == {"a": "blocked_by", "b": "unexpected case", "c": "missing outcome"}
    spans = spark.createDataFrame([("r", "tool_call", [1]), ("r", "input", [1]), ("r", "output", [])], "request_id string, checkpoint string, spans array<int>")
    assert {r.checkpoint: r.action for r in scans.redaction_effect(spans).collect()} == {"tool_call": "allow", "input": "redact", "output": "allow"}


def test_keyword_bounds(spark):
    """The MaxScore walk equals scoring every pair, looks at few of them, and returns at most k rows a query and task."""
    r = random.Random(4)
    text = lambda n: " ".join(f"word{min(int(r.paretovariate(0.8)), 400)}" for _ in range(n))
    rows = [(i, text(r.randrange(1, 80))) for i in range(1500)] + [(5000 + i, "word3 word4 word5 word9") for i in range(60)] + [(9000, None), (9001, ""), (9002, "a b")]
    asked = [(i, text(r.randrange(1, 12))) for i in range(25)] + [(100, "word3 word4 word5 word9"), (101, None), (102, "to"), (103, "unheard")]
    chunks, queries = spark.createDataFrame(rows, "chunk_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, text string")
    words = lambda t: {w for w in (t or "").split() if len(w) > 2}
    want = []
    for q, t in asked:
        scores = [(-keywords.rounded(len(words(t) & words(c)) / (len(words(t)) * len(words(c))) ** 0.5), i) for i, c in rows if words(t) & words(c)]
        want += [(q, i, -s, rank + 1) for rank, (s, i) in enumerate(sorted(scores)[:7])]
    got = retrieval.keyword_search_many(chunks, queries, 7)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    work = keywords.keyword_work(chunks, queries, retrieval.tokens_of, 7).first()
    assert work.pairs == 27 * 1563
    assert work.looked_at < work.pairs
    found = keywords._passes(chunks, queries, retrieval.tokens_of, 7, False, "query_id long, chunk_id long, score double")
    assert found.groupBy("query_id", F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] <= 7


def test_rounding_is_that_of_spark(spark):
    r = random.Random(1)
    values = [r.random() for _ in range(300)] + [i / 20000 for i in range(300)] + [s / (n * m) ** 0.5 for s in (1, 2, 3) for n in (3, 7, 16) for m in (5, 25)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [x.r for x in df.select(F.round("v", 4).alias("r")).collect()] == [keywords.rounded(v) for v in values]


def test_fingerprint_trees(spark):
    rows = [(i, f"text {i}", None if i % 3 else "x") for i in range(3000)] + [(None, "a", None), (None, "a", None)]
    docs = spark.createDataFrame(rows, "document_id long, text string, title string")
    tree = fingerprints.fingerprint_tree(docs, depth=2).cache()
    assert fingerprints.depth_for(0) == fingerprints.depth_for(256) == 0 and fingerprints.depth_for(257) == 1 and fingerprints.depth_for(256 * 256 + 1) == 3
    assert {r.level: (r.n, r.rows) for r in tree.groupBy("level").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).collect()} == {0: (1, 3002), 1: (16, 3002), 2: (256, 3002)}
    assert fingerprints.source_fingerprint(docs.repartition(5)).first().fingerprint == tree.filter("level = 0").first().digest
    assert fingerprints.fingerprint_tree(docs.limit(0)).count() == 0
    other = docs.withColumn("text", F.when(F.col("document_id") == 77, "other").otherwise(F.col("text")))
    ranges = fingerprints.changed_ranges(tree, fingerprints.fingerprint_tree(other, depth=2), 2)
    assert ranges.count() == 1 and ranges.join(tree.filter("level = 2"), "range").first().rows < 40
    assert [tuple(r) for r in fingerprints.changed_rows(docs, other, ranges, 2).collect()] == [(77, "changed")]
    assert fingerprints.changed_ranges(tree, tree, 2).count() == 0
    one_less = docs.filter("document_id IS NOT NULL").union(docs.filter("document_id IS NULL").limit(1))  # of two equal rows one is gone
    ranges = fingerprints.changed_ranges(tree, fingerprints.fingerprint_tree(one_less, depth=2), 2)
    assert [tuple(r) for r in fingerprints.changed_rows(docs, one_less, ranges, 2).collect()] == [(None, "changed")]


def test_a_writer_that_dies_leaves_the_old_index(spark, tmp_path, monkeypatch):
    path, state = str(tmp_path / "index"), spark.createDataFrame([{"fingerprint": "x", "rows": 1}])
    rows = lambda v: spark.createDataFrame([(1, v)], "chunk_id long, body string")
    read = lambda: [(r.body, s.first().version) for c, s in [retrieval.read_index(spark, path)] for r in c.collect()]
    assert retrieval.read_index(spark, path) is None
    assert retrieval.write_index(rows("old"), state, path, "v1") == 1
    open_reader = retrieval.read_index(spark, path)[0]
    commit = versions.commit
    monkeypatch.setattr(versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("the writer died")))
    with pytest.raises(RuntimeError, match="died"):
        retrieval.write_index(rows("torn"), state, path, "v2")
    monkeypatch.setattr(versions, "commit", commit)
    assert read() == [("old", "v1")]
    assert retrieval.write_index(rows("new"), state, path, "v2") == 2 and read() == [("new", "v2")]
    assert [r.body for r in open_reader.collect()] == ["old"]  # a version's data stay as they were
    with pytest.raises(versions.VersionConflict):
        versions.commit(spark, path, {"data": "x"}, 2)
    assert read() == [("new", "v2")] and versions.version_numbers(spark, path) == [1, 2]
    versions.prune(spark, path, 1)
    assert read() == [("new", "v2")] and len(list((tmp_path / "index").glob("data-*"))) == 1


def test_relational_load(spark, tmp_path, tables):
    url = f"jdbc:derby:{tmp_path / 'db'};create=true"
    rows = lambda pairs: spark.createDataFrame(pairs, "transaction_id long, note string")
    got = lambda: sorted(tuple(r) for r in relational.read(spark, url, "notes", "transaction_id").collect())
    load = lambda pairs, **o: relational.load(rows(pairs).repartition(3), url, "notes", "transaction_id", {"note": "VARCHAR(20)"}, **o)
    load([])
    assert got() == []
    for _ in range(2):
        load([(1, "a"), (2, "b"), (2, "b"), (900, None)])
        assert got() == [(1, "a"), (2, "b"), (900, None)]
    load([(2, "other"), (3, "c")], connections=1)
    assert got() == [(1, "a"), (2, "other"), (3, "c"), (900, None)]
    with pytest.raises(Exception, match="note is longer than 20"):
        load([(1, "changed"), (4, "x" * 50)])  # fails in the store
    assert got() == [(1, "a"), (2, "other"), (3, "c"), (900, None)]
    left = spark.read.jdbc(url, "(SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T') t").collect()
    assert [r[0] for r in left] == ["NOTES"]


def test_vector_search_in_passes(spark, monkeypatch):
    """Queries that are too many for one broadcast take several passes, and give what all pairs give."""
    r = random.Random(6)
    vector = lambda: [r.gauss(0, 1) for _ in range(8)]
    rows = [(i, f"s{i % 3}", vector()) for i in range(400)]
    rows += [(1000 + i, "s0", rows[0][2]) for i in range(30)]  # ties
    asked = [(i, scope, v) for i, scope, v in rows[:40]] + [(9, "nowhere", vector())]
    chunks, queries = spark.createDataFrame(rows, "chunk_id long, scope string, embedding array<float>").repartition(3), spark.createDataFrame(asked, "query_id long, scope string, embedding array<float>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {q: [c for _, c in sorted((round(1 - cos(v, w), 5), c) for c, t, w in rows if t == scope)[:5]] for q, scope, v in asked if scope != "nowhere"}
    for size in (32 << 20, 700):
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", size)
        got = {}
        for x in retrieval.search_many(chunks, queries, 5).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append(x.chunk_id)
        assert got == want
    assert retrieval.search_many(chunks, queries.limit(0), 5).count() == 0


def test_safe_labels_keep_the_labels(spark, tmp_path):
    from hashlib import sha256

    from sparkguard.plans import file_queries

    spark.createDataFrame([(1, "one"), (2, "a b\nc d-e"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.label, r.names, r.unprintable, r.labels) for r in file_queries.QUERIES["safe_labels"](spark, str(tmp_path)).collect()}
    hidden, digest = "<unprintable name>", lambda *labels: sha256(" ".join(labels).encode()).hexdigest()
    assert got == {1: ("one", 1, 0, digest("one")), 2: (hidden, 3, 1, digest("a", hidden, "d-e")), 3: (hidden, 1, 1, digest(hidden))}
