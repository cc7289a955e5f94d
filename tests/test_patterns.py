"""Automata against searching for each pattern by itself."""

import pickle
import random
import re
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkguard.functions import patterns as P
from sparkguard.operators import corpus, scans


@pytest.mark.parametrize(
    ("pattern", "sets"),
    [
        (r"\bignore\s+(?:all\s+)?rules\b", [{"ignore"}, {"rules"}]), (r"(?:curl|wget)\b[^|]*\|\s*(?:ba|z)?sh", [{"curl", "wget"}, {"|"}, {"sh"}]), (r"a?b*", []), (r"(?:abc|d?)", []), (r"(?:ab){2,}c+", [{"ab"}, {"c"}]),
        (r"x(?=yes)(?!no)z", [{"x"}, {"yes"}, {"z"}]), (r"(?P<n>key)=\d(?P=n)", [{"key"}, {"="}]), (r"[ab]c", [{"c"}]), (r"^end$", [{"end"}]), (r"SẞK", [{"sssk"}]), (r".", []),
    ],
)
def test_required_literals(pattern, sets):
    assert sorted(map(sorted, P.required_literals(pattern, False))) == sorted(map(sorted, sets))


_PIECES = ["ab", "ba", "a", "(?:ab|ca)", "(?:a|bc)+", "[abc]", "c?", "b*", r"\b", "(?:b(?:a|c))?", "c{2}", ".", "(?i:A)", "İ", "k", "ſ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_PIECES), min_size=1, max_size=4).map("".join), min_size=1, max_size=8), st.text("abcABC kKıiİſsS", max_size=12), st.booleans())
def test_feed_equals_each_signature(patterns, text, sensitive):
    feed = pickle.loads(pickle.dumps(P.Feed([(p, sensitive) for p in patterns])))
    want = next((i for i, p in enumerate(patterns) if re.search(p, text, 0 if sensitive else re.I)), None)
    assert feed.first([text]) == want and feed.first(["", text]) == min((i for i in (want, feed.first([""])) if i is not None), default=None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", min_size=0, max_size=3), max_size=6), st.text("abé", max_size=30))
def test_places_equal_find(words, text):
    want = []
    for w in set(words) - {""}:
        at = text.find(w)
        while at >= 0:
            want.append((at, at + len(w), w))
            at = text.find(w, at + len(w))
    made = P.automaton((w, w) for w in dict.fromkeys(words))
    assert sorted((s, e, v) for s, e, values in P.occurrences(made, text) for v in values) == sorted(want)
    every = sorted((i, i + len(w), w) for w in set(words) - {""} for i in range(len(text)) if text.startswith(w, i))
    assert sorted((s, e, v) for s, e, values in P.occurrences(made, text, True) for v in values) == every


def test_time_hardly_grows_with_the_feed():
    r = random.Random(1)
    text = " ".join(f"word{r.randrange(10_000)}" for _ in range(40_000))

    def took(n):
        feed = P.Feed([(rf"\bsignature{i}\s+of\s+attack{i}\b", False) for i in range(n)])
        start = time.perf_counter()
        assert feed.first([text]) is None
        return time.perf_counter() - start

    assert took(2000) < 4 * took(20) + 0.2


def test_known_values_of_all_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "aaa bé a"), (2, None), (3, ""), (4, "x")], "document_id long, text string")
    values = spark.createDataFrame([("k", "aa"), ("k", "a"), ("m", "aa"), ("m", "bé"), ("m", ""), ("m", None)], "kind string, value string")
    want = [("k", 0, 1, "a"), ("k", 0, 2, "aa"), ("m", 0, 2, "aa"), ("k", 1, 2, "a"), ("k", 2, 3, "a"), ("m", 4, 6, "bé"), ("k", 7, 8, "a")]
    for size in (1 << 20, 1):
        monkeypatch.setattr(corpus, "VALUE_BYTES", size)
        got = {r.document_id: [tuple(s) for s in r.spans] for r in corpus.annotate_spans(docs, values).collect()}
        assert got == {1: want, 2: [], 3: [], 4: []}
    assert len(corpus.annotate_spans(docs, values, overlapping=True).filter("document_id = 1").first().spans) == 9


def test_a_signature_that_fails_is_an_error(spark):
    texts = spark.createDataFrame([("r", 0, "abc"), ("s", 0, "nothing")], "request_id string, message_index int, content string")
    feed = [("A", "other", "fine", "abc", True), ("B", "other", "broken when it runs", "nothing", True)]

    class Broken:
        def first(self, forms):
            raise RecursionError(forms[0])

    assert [r.verdict for r in scans.scan_signatures(texts, feed).orderBy("request_id").collect()] == ["block", "block"]
    original, scans.Feed = scans.Feed, lambda signatures: Broken()
    try:
        rows = scans.scan_signatures(texts, feed).orderBy("request_id").collect()
    finally:
        scans.Feed = original
    assert [(r.request_id, r.verdict, r.reason) for r in rows] == [("r", "error", "scan failed: RecursionError"), ("s", "error", "scan failed: RecursionError")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abé", max_size=3), st.sampled_from("km")), max_size=6, unique=True), st.text("abé", max_size=30), st.booleans())
def test_places_in_columns(pairs, text, overlapping):
    want = sorted((s, e, k, text[s:e]) for s, e, kinds in P.occurrences(P.automaton(pairs), text, overlapping) for k in kinds)
    values = pickle.loads(pickle.dumps(P.Values(pairs)))
    start, end, word, kind = values.places(text, overlapping).tolist()
    assert list(zip(start, end, (values.kinds[k].as_py() for k in kind), (values.words[w].as_py() for w in word), strict=True)) == want


def test_spans_of_many_texts_come_in_small_batches(spark, monkeypatch):
    """A batch of texts isn't turned into one batch of spans, as there may be one for each letter; all of them are found."""
    from sparkguard.session import BATCH_ROWS

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(corpus, "SPANS", 100)
    docs = spark.range(3000).selectExpr("id AS document_id", "repeat('ab', 30) AS text").repartition(1)
    known, own = spark.createDataFrame([("k", "a"), ("k", "ba")], "kind string, value string"), docs.selectExpr("document_id", "'k' AS kind", "if(document_id % 2 = 0, 'a', 'ba') AS value")
    assert [tuple(r) for r in corpus.annotate_spans(docs, known).selectExpr("size(spans) AS n").groupBy("n").count().collect()] == [(59, 3000)]
    assert sorted(tuple(r) for r in corpus.annotate_spans(docs, own).selectExpr("size(spans) AS n").groupBy("n").count().collect()) == [(29, 1500), (30, 1500)]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS


def test_a_slice_of_spans_ends_with_the_text_that_fills_it(spark, monkeypatch):
    """What a worker holds doesn't follow the batch: a slice has fewer than SPANS places before its last text."""
    made = []
    monkeypatch.setattr(corpus, "SPANS", 100)
    docs = spark.createDataFrame([], "document_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, work, schema: made.append(work) or spark.createDataFrame([], schema))
    corpus.annotate_spans(docs, spark.createDataFrame([("k", "a")], "kind string, value string"))
    texts = ["ab" * (i % 40) for i in range(500)]
    slices = list(made[0](iter([pa.RecordBatch.from_pydict({"document_id": list(range(500)), "text": texts})])))
    sizes = [[len(x) for x in s.column(2).to_pylist()] for s in slices]
    assert len(slices) > 50 and all(sum(n[:-1]) < 100 for n in sizes)
    assert [n for s in sizes for n in s] == [i % 40 for i in range(500)]
    assert [x for s in slices for x in s.column("text").to_pylist()] == texts


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["ab", "b", "İ", " ", r"\s", r"\s+", r"\s{2,}?", "[ \t]+", r"\s*", r"[^\s]", r"(?:a\s|b)", r"(?:\s+c)?", "̇", r"\b"]), min_size=1, max_size=5).map("".join), min_size=1, max_size=6), st.text("abcİi̇ \t ", max_size=12), st.booleans())
def test_feed_with_white_space_equals_each_signature(patterns, text, sensitive):
    want = next((i for i, p in enumerate(patterns) if re.search(p, text, 0 if sensitive else re.I)), None)
    assert P.Feed([(p, sensitive) for p in patterns]).first([text]) == want


def test_words_in_another_order_are_no_candidates():
    feed = P.Feed([(r"\bone\s+two\b", False), (r"\btwo[ \n]one\b", False), (r"\bone\s*two\b", False)])
    assert feed.candidates(["two three one"]) == [2] and feed.candidates(["x ONE \t\n two"]) == [0, 2]
    assert [feed.first([t]) for t in ("one  Two", "two\none", "onetwo", "two  one")] == [0, 1, 2, None]


def test_texts_are_searched_once(spark):
    """The filter of what was found isn't moved before the search, and plain and other texts are of one scan."""
    texts = spark.createDataFrame([("r", 0, "abc"), ("s", 0, "é аbc"), ("t", 0, None), ("u", 0, "é")], "request_id string, message_index int, content string")
    found = scans.scan_signatures(texts, [("A", "other", "fine", "abc", True)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [first(") == 1 and plan.count("ArrowEvalPython [nfkc(") == 1
    assert sorted(r.request_id for r in found.collect()) == ["r", "s"]
