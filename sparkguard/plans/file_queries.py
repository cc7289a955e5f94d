"""Registered queries of sources, sinks, ingest, retrieval and evaluation operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import access, browse, chat, corpus, decisions, metrics, retrieval, scans, tool_args
from ..schemas import AUDIT
from ..session import shared_dir
from ..sources import audit as A
from ..sources import corpus as files
from ..sources import relational, versions
from . import sql as S
from . import views as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function of (spark, sf_dir) by its name, with the SQL of its rows."""

    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: V.rounded(f(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return wrap


# --- audit files ------------------------------------------------------------------------------

_BASE = ["id", "ts", "request_id", "caller_id", "model", "checkpoint", "check", "action", "reason", "score", "latency_ms", "decided_by", "tokens", "cost", "policy_version"]


def _records(spark: SparkSession, d: str) -> DataFrame:
    rows = V.audit(spark, d)
    return rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in AUDIT])


@query(S.with_audit("SELECT id, strftime(date, '%Y-%m-%d') AS date, hour, minute, is_block, category FROM audit WHERE id % 50 <> 0 AND id % 51 <> 0 AND id % 53 <> 0 AND ts_utc >= TIMESTAMP '2024-01-05 12:00:00'"))
def audit_read_lines(spark: SparkSession, d: str) -> DataFrame:
    """Day files with torn lines, unknown actions, missing fields and blank lines among the good ones."""
    k = F.col("id")
    rows = _records(spark, d).withColumn("action", F.when(k % 51 == 0, "explode").otherwise(F.col("action"))).withColumn("check", F.when(k % 53 != 0, F.col("check")))
    text = F.to_json(F.struct(*_BASE))
    lines = rows.select(F.when(k % 50 == 0, F.substring(text, 1, 40)).otherwise(text).alias("value"), k.alias("k"))
    path = shared_dir(spark, "audit")
    lines.unionByName(lines.filter("k % 97 = 0").select(F.lit("").alias("value"), "k")).select("value").write.text(f"{path}/audit-2024-01-01.jsonl")
    return A.read_audit(spark, path, "2024-01-05T12:00:00Z").select("id", "date", "hour", "minute", "is_block", "category")


@query(S.with_audit("SELECT strftime(date, '%Y-%m-%d') AS date, 2 * count(*) AS rows, CAST(2 * sum(tokens) AS BIGINT) AS tokens, 2 * count(*) FILTER (WHERE is_block) AS blocks FROM audit GROUP BY 1"))
def audit_append(spark: SparkSession, d: str) -> DataFrame:
    """Two appends to the store of one folder per day."""
    path, rows = shared_dir(spark, "audit"), _records(spark, d)
    A.write_audit(rows, path)
    A.write_audit(A.union_rows(rows.filter("tools IS NULL").drop("tools"), rows.filter("tools IS NOT NULL")), path)
    return spark.read.parquet(path).groupBy("date").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"), F.count_if("is_block").alias("blocks"))


@query(S.with_audit("""SELECT id, "check", CAST(is_block AS VARCHAR) AS is_block, minute FROM audit"""))
def audit_export_csv(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "csv")
    A.export_csv(_records(spark, d), path)
    return spark.read.option("header", True).csv(path).select(F.col("id").cast("long"), "check", "is_block", "minute")


@query(S.with_audit("SELECT id, request_id, tokens, reason FROM audit"))
def audit_export_json(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "json")
    A.export_json(_records(spark, d), path)
    return spark.read.schema(AUDIT).json(path).select("id", "request_id", "tokens", "reason")


@query(S.with_audit("""SELECT id, conversation_id, tools FROM audit WHERE "check" = 'turn_summary'"""))
def audit_export_turns(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "csv")
    A.export_turns(_records(spark, d), path)
    return spark.read.option("header", True).csv(path).select(F.col("id").cast("long"), "conversation_id", "tools")


@query(S.with_audit("SELECT count(*) AS requests, 2 AS snapshots, 1 AS latest FROM requests", S.REQUESTS))
def metrics_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots: the history keeps both, the latest is one."""
    path, totals = shared_dir(spark, "snapshots"), metrics.totals(metrics.requests(V.audit(spark, d)))
    for _ in range(2):
        A.write_snapshot(totals, path)
    history, latest = spark.read.parquet(f"{path}/history"), spark.read.json(f"{path}/latest")
    return history.agg(F.max("requests").alias("requests"), F.count("*").cast("int").alias("snapshots")).crossJoin(latest.agg(F.count("*").cast("int").alias("latest")))  # one row each


@query(S.with_audit("SELECT *, (SELECT count(*) FROM audit WHERE action = 'block') AS total FROM (SELECT id, \"check\" FROM audit WHERE action = 'block' ORDER BY id DESC LIMIT 20 OFFSET 5)"))
def audit_page_total(spark: SparkSession, d: str) -> DataFrame:
    return browse.page_with_total(browse.search(V.audit(spark, d), action="block"), 5, 20).select("id", "check", "total")


# --- chat logs --------------------------------------------------------------------------------

_TURN = "CASE WHEN role = 'assistant' THEN 'assistant' WHEN turn = 0 AND conv_id % 3 = 0 THEN 'system' ELSE 'user' END"


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """One request body per conversation: a developer's first turn in every third, contents as lists of parts for odd turns, a call in the last turn; some are broken."""
    c, k, t = V.read(spark, d, "conversations"), F.col("conv_id"), F.col("turn")
    role = F.when(F.col("role") == "assistant", "assistant").when((t == 0) & (k % 3 == 0), "developer").when(k % 13 == 5, "alien").otherwise("user")
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.to_json(F.array(part("text", F.col("text")), part("image", F.lit("no")), part("text", F.lit("!"))))
    content = F.when(t % 2 == 1, parts).otherwise(F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2))
    call = F.concat(F.lit(', "tool_calls": [{"id": "1", "type": "function", "function": {"name": "look", "arguments": '), F.when(k % 11 == 3, '"[1]"').when(k % 2 == 0, '""').otherwise(F.concat(F.lit('"{\\"n\\": '), k.cast("string"), F.lit('}"'))), F.lit("}}]"))
    message = F.concat(F.lit('{"role": "'), role, F.lit('", "content": '), content, F.when(t == 1, call).otherwise(""), F.lit("}"))
    bodies = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]), ", ").alias("ms"))
    body = F.concat(F.lit('{"model": "m", "messages": ['), "ms", F.when(F.col("conv_id") % 17 == 2, "").otherwise("]}"))
    return bodies.select(F.concat(F.lit("c"), "conv_id").alias("request_id"), F.lit("u").alias("caller_id"), body.alias("body"))


_GOOD = """bad AS (SELECT conv_id, CASE WHEN conv_id % 17 = 2 THEN 'not a chat request' WHEN bool_or(role <> 'assistant' AND NOT (turn = 0 AND conv_id % 3 = 0) AND conv_id % 13 = 5) THEN 'unknown role'
  WHEN conv_id % 11 = 3 AND bool_or(turn = 1) THEN 'tool arguments are not an object' END AS reason FROM conversations GROUP BY conv_id)"""


@query(f"WITH {_GOOD} SELECT 'c' || conv_id AS request_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS message_index, {_TURN} AS role, CASE WHEN turn % 2 = 1 THEN text || '!' ELSE text END AS content FROM conversations JOIN bad USING (conv_id) WHERE reason IS NULL")
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    return chat.normalize_chat(_bodies(spark, d))["messages"].drop("tool_call_id")


@query(f"WITH {_GOOD} SELECT 'c' || conv_id AS request_id, 'look' AS name, CASE WHEN conv_id % 2 = 0 THEN '{{}}' ELSE '{{\"n\": ' || conv_id || '}}' END AS arguments FROM conversations JOIN bad USING (conv_id) WHERE reason IS NULL AND turn = 1")
def chat_calls(spark: SparkSession, d: str) -> DataFrame:
    return chat.normalize_chat(_bodies(spark, d))["calls"].select("request_id", "name", "arguments")


@query(f"WITH {_GOOD} SELECT 'c' || conv_id AS request_id, reason AS bad_request FROM bad WHERE reason IS NOT NULL")
def chat_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return chat.normalize_chat(_bodies(spark, d))["bad"].select("request_id", "bad_request")


@query("SELECT conv_id || '-' || turn AS request_id, text AS content, CASE WHEN conv_id % 2 = 0 THEN conv_id ELSE 0 END AS prompt_tokens, CASE WHEN turn % 3 = 0 THEN 'tool_call' ELSE 'output' END AS checkpoint FROM conversations")
def chat_replies(spark: SparkSession, d: str) -> DataFrame:
    """First choices with missing counts and, in every third turn, a call."""
    k, t = F.col("conv_id"), F.col("turn")
    body = F.concat(F.lit('{"choices": [{"message": {"role": "other", "content": '), F.expr("substring(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)"), F.when(t % 3 == 0, ', "tool_calls": [{"id": "a", "function": {"name": "f", "arguments": "{}"}}]').otherwise(""), F.lit('}}, {"message": {"content": "second"}}]'), F.when(k % 2 == 0, F.concat(F.lit(', "usage": {"prompt_tokens": '), k.cast("string"), F.lit("}"))).otherwise(""), F.lit("}"))
    rows = V.read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), body.alias("body"))
    return chat.reply_checkpoints(chat.normalize_replies(rows)).select("request_id", "content", "prompt_tokens", "checkpoint")


@query("""WITH t AS (SELECT conv_id, arg_max(text, turn) FILTER (WHERE role <> 'assistant' AND text <> '') AS task, count(*) AS n FROM conversations GROUP BY conv_id)
  SELECT 'c' || conv_id AS request_id, 'task: ' || coalesce(task, '(none)') || chr(10) || 'agent reasoning: (none)' || chr(10) || 'tool calls: [{"name":"look","arguments":"' || n || '"}]' AS view FROM t""")
def call_views(spark: SparkSession, d: str) -> DataFrame:
    c = V.read(spark, d, "conversations").withColumn("request_id", F.concat(F.lit("c"), "conv_id"))
    messages = c.select("request_id", F.col("turn").alias("message_index"), F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"), F.col("text").alias("content"))
    calls = c.groupBy("request_id").agg(F.lit(0).alias("position"), F.lit("look").alias("name"), F.count("*").cast("string").alias("arguments"))
    return chat.call_views(messages, calls)


@query("""WITH m AS (SELECT conv_id, turn, role FROM conversations), s AS (SELECT conv_id, max(turn) FILTER (WHERE role <> 'assistant') AS start FROM m GROUP BY conv_id),
  c AS (SELECT conv_id, turn % 2 AS args, count(*) AS n FROM m JOIN s USING (conv_id) WHERE role = 'assistant' AND (start IS NULL OR turn > start) GROUP BY 1, 2)
  SELECT 'c' || conv_id AS request_id, CAST(sum(n) AS BIGINT) AS calls, max(n) AS repeats, CASE WHEN sum(n) > 1 OR max(n) > 1 THEN 'block' ELSE 'allow' END AS verdict FROM c GROUP BY conv_id""")
def loops_since_user(spark: SparkSession, d: str) -> DataFrame:
    """Only calls after the last user message count."""
    m = V.read(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("request_id"), F.col("turn").alias("message_index"), F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"))
    calls = m.filter("role = 'assistant'").select("request_id", "message_index", F.lit("look").alias("name"), F.col("message_index").alias("position"), F.concat(F.lit('{"n": '), (F.col("message_index") % 2).cast("string"), F.lit("}")).alias("arguments"))
    return access.check_loops(calls, 1, 1, m).drop("reason")


_NAME = "[A-Za-z_][A-Za-z0-9_.:-]{0,63}"


@query(f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(string_split(coalesce(text, ''), ' '), lambda w: CASE WHEN regexp_full_match(w, '{_NAME}') THEN w ELSE '<unprintable name>' END) AS labels FROM documents)
  SELECT doc_id, CASE WHEN regexp_full_match(text, '{_NAME}') THEN text ELSE '<unprintable name>' END AS label, CAST(len(labels) AS BIGINT) AS names, CAST(len(list_filter(labels, lambda x: x = '<unprintable name>')) AS BIGINT) AS unprintable, sha256(array_to_string(labels, ' ')) AS labels FROM w""")
def safe_labels(spark: SparkSession, d: str) -> DataFrame:
    """The whole text of every document as a name, and each of its words as one; all labels are in the digest."""
    whole = F.coalesce("text", F.lit(""))
    found = V.read(spark, d, "documents").select("doc_id", C.safe_label(whole).alias("label"), F.transform(F.split(whole, " ", -1), C.safe_label).alias("labels"))
    return found.select("doc_id", "label", F.size("labels").cast("long").alias("names"), F.size(F.filter("labels", lambda x: x == "<unprintable name>")).cast("long").alias("unprintable"), F.sha2(F.array_join("labels", " "), 256).alias("labels"))


# --- scans ------------------------------------------------------------------------------------


@query(r"""WITH v AS (SELECT doc_id, translate(coalesce(text, ''), 'aeop', 'аеор') || chr(8203) || 'x' AS t FROM documents)
  SELECT doc_id, 3 AS n, sha256(replace(translate(t, 'аеор', 'aeop'), chr(8203), '')) AS joined, sha256(replace(translate(t, 'аеор', 'aeop'), chr(8203), ' ')) AS spaced FROM v""")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts in look-alike letters with an invisible character: what the forms make of them."""
    t = F.concat(F.translate(F.coalesce("text", F.lit("")), "aeop", "аеор"), F.lit("​x"))
    forms = scans.text_forms(V.read(spark, d, "documents").select("doc_id", t.alias("content")))
    return forms.select("doc_id", F.size("forms").alias("n"), F.sha2(F.get("forms", F.lit(1)), 256).alias("joined"), F.sha2(F.get("forms", F.lit(2)), 256).alias("spaced"))


_EMAIL = "[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\\.)+[A-Za-z]{2,24}"


@query(f"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_EMAIL}')) AS n, sha256(regexp_replace(coalesce(text, ''), '{_EMAIL}', '[REDACTED:EMAIL]', 'g')) AS redacted FROM documents""")
def find_emails(spark: SparkSession, d: str) -> DataFrame:
    found = scans.find_pii(V.read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content")), types=("email",))
    return found.select("doc_id", F.size("spans").alias("n"), F.sha2("redacted", 256).alias("redacted"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'input' WHEN 1 THEN 'tool_call' ELSE 'output' END AS checkpoint, CASE WHEN doc_id % 3 <> 1 AND contains(text, '@') THEN 'redact' ELSE 'allow' END AS action, coalesce(contains(text, '@'), false) AS touched FROM documents")
def redaction_effects(spark: SparkSession, d: str) -> DataFrame:
    place = F.when(F.col("doc_id") % 3 == 0, "input").when(F.col("doc_id") % 3 == 1, "tool_call").otherwise("output")
    rows = V.read(spark, d, "documents").select("doc_id", place.alias("checkpoint"), F.when(F.contains("text", F.lit("@")), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("spans"))
    return scans.redaction_effect(rows).drop("spans")


@query("""SELECT doc_id, p.path, p.key, p.value FROM (SELECT doc_id, unnest([{'path': 'a.b[0]', 'key': 'b', 'value': coalesce(text, '')}, {'path': 'a.b[1].' || source, 'key': source, 'value': lang}, {'path': '<unprintable name>', 'key': 'no name', 'value': 'z'}]) AS p FROM documents) WHERE p.value IS NOT NULL""")
def argument_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Strings of nested arguments that hold whole texts."""
    text = F.expr("substring(to_json(struct(coalesce(text, '') AS t)), 6, length(to_json(struct(coalesce(text, '') AS t))) - 6)")
    lang = F.coalesce(F.concat(F.lit('"'), "lang", F.lit('"')), F.lit("null"))
    arguments = F.concat(F.lit('{"a": {"b": ['), text, F.lit(', {"'), "source", F.lit('": '), lang, F.lit('}]}, "no name": "z", "n": 1}'))
    return tool_args.explode_args(V.read(spark, d, "documents").select("doc_id", arguments.alias("arguments"))).select("doc_id", "path", "key", "value")


@query("""WITH w AS (SELECT p_partkey, regexp_split_to_array(lower(p_name), '[^a-z0-9]+') AS a, CASE WHEN p_partkey % 3 = 0 THEN 'run_shell' WHEN p_partkey % 3 = 1 THEN 'openBash' ELSE 'shelling' END AS name, CASE WHEN p_partkey % 4 = 0 THEN 'outFile' WHEN p_partkey % 4 = 1 THEN 'cmd' ELSE 'files_of' END AS key FROM part)
  SELECT p_partkey, p_partkey % 3 < 2 OR p_partkey % 4 = 1 AS is_shell, p_partkey % 4 <> 1 AS is_path FROM w""")
def argument_hints(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = V.read(spark, d, "part").select("p_partkey", F.when(k % 3 == 0, "run_shell").when(k % 3 == 1, "openBash").otherwise("shelling").alias("name"), F.when(k % 4 == 0, "outFile").when(k % 4 == 1, "cmd").otherwise("files_of").alias("key"))
    return tool_args.arg_hints(rows).select("p_partkey", "is_shell", "is_path")


# --- retrieval --------------------------------------------------------------------------------


@query("""SELECT vec_id, CASE WHEN vec_id % 7 = 1 OR vec_id % 7 = 5 THEN 'dimension' WHEN vec_id % 7 = 2 OR vec_id % 7 = 3 THEN 'not finite' WHEN vec_id % 7 = 4 THEN 'all zero' END AS problem FROM embeddings""")
def faulty_vectors(spark: SparkSession, d: str) -> DataFrame:
    k, e = F.col("vec_id") % 7, F.col("embedding")
    last = lambda x: F.concat(F.slice(e, 1, 63), F.array(x.cast("float")))
    changed = F.when(k == 1, F.slice(e, 1, 63)).when(k == 2, last(F.lit("NaN"))).when(k == 3, last(F.lit(None))).when(k == 4, F.transform(e, lambda x: x * 0)).when(k == 5, F.lit(None)).otherwise(e)
    return retrieval.validate_vectors(V.read(spark, d, "embeddings").withColumn("embedding", changed), 64).select("vec_id", "problem")


def _scoped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, documents of clients (a third public guides, some of no client and not public) and links to payments."""
    v = V.read(spark, d, "embeddings")
    k = F.col("vec_id")
    docs = v.select(k.alias("document_id"), F.when(k % 3 != 0, k % 5).alias("client_id"), F.when(k % 6 == 0, "internal").otherwise("public").alias("classification"))
    return v.select(k.alias("document_id"), k.alias("chunk_id"), "embedding"), docs, v.select(k.alias("document_id"), (k % 4).alias("transaction_id"))


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE (vec_id % 3 <> 0 AND vec_id % 5 = 2) OR (vec_id % 3 = 0 AND vec_id % 6 <> 0)")
def visible_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks, docs, _ = _scoped(spark, d)
    return retrieval.visible(chunks, docs, 2).select("chunk_id")


_COS = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) / sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))"


@query(f"SELECT a.vec_id AS chunk_id FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id = 5) q WHERE ((a.vec_id % 3 <> 0 AND a.vec_id % 5 = 2) OR (a.vec_id % 3 = 0 AND a.vec_id % 6 <> 0)) AND a.vec_id % 4 = 1 ORDER BY 1 - {_COS}, a.vec_id LIMIT 7")
def scoped_search(spark: SparkSession, d: str) -> DataFrame:
    """The nearest chunks that a client may see, of documents that are linked to a payment."""
    chunks, docs, links = _scoped(spark, d)
    vector = V.read(spark, d, "embeddings").filter("vec_id = 5").first().embedding
    return retrieval.search(retrieval.visible(chunks, docs, 2), vector, 7, links, 1).select("chunk_id")


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documents with headings around their text: a title of two levels and, in some, a fence that hides one."""
    k = F.col("doc_id").cast("string")
    fence = F.when(F.col("doc_id") % 3 == 0, "```\n## hidden\n```\n").otherwise("")
    text = F.concat(F.lit("# Top "), k, F.lit("\n\n## Body\n"), fence, F.regexp_replace(F.coalesce("text", F.lit("")), "[\n#`~]", " "), F.lit("\n#### Deep ##\nend"))
    return V.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit("T").alias("title"), text.alias("text"))


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '```' || chr(10) ELSE '' END AS fence, regexp_replace(coalesce(text, ''), '[\\n#`~]', ' ', 'g') || chr(10) || '#### Deep ##' || chr(10) || 'end' AS rest FROM documents),
  s AS (SELECT doc_id AS document_id, unnest([{'p': 0, 't': '# Top ' || doc_id || chr(10) || chr(10)}, {'p': 1, 't': '## Body' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN fence ELSE rest END}, {'p': 2, 't': '## hidden' || chr(10) || fence || rest}]) AS x FROM b)
  SELECT document_id, CAST(x.p AS INTEGER) AS position, sha256(x.t) AS section FROM s WHERE x.p < 2 OR document_id % 3 = 0""")
def markdown_h2(spark: SparkSession, d: str) -> DataFrame:
    """A plain split at second-level headings, fences included, as the operator's definition says."""
    return retrieval.h2_sections(_markdown(spark, d)).select("document_id", F.col("position").cast("int"), F.sha2("section", 256).alias("section"))


@query("""WITH d AS (SELECT doc_id, 8 + length(CAST(doc_id AS VARCHAR)) AS top, 8 + CASE WHEN doc_id % 3 = 0 THEN 18 ELSE 0 END + length(coalesce(text, '')) + 1 AS body FROM documents)
  SELECT doc_id AS document_id, p.path, CAST(p.s AS INTEGER) AS char_start, CAST(p.e AS INTEGER) AS char_end FROM (SELECT doc_id, unnest([{'path': 'Top ' || doc_id, 's': 0, 'e': top}, {'path': 'Top ' || doc_id || ' > Body', 's': top, 'e': top + body}, {'path': 'Top ' || doc_id || ' > Body > Deep', 's': top + body, 'e': top + body + 16}]) AS p FROM d)""")
def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    """With a large budget a chunk is a section: its path skips levels, and fenced headings open none."""
    found = retrieval.chunk(_markdown(spark, d), len, 10_000_000)
    return found.select("document_id", F.array_join("section_path", " > ").alias("path"), "char_start", "char_end")


@query("""SELECT doc_id AS document_id, CAST((length(coalesce(text, '')) + 3) % 7 AS DOUBLE) AS first FROM documents WHERE length(text) > 0""")
def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct input once through an encoder (here of lengths), joined back to its chunks."""
    docs = V.read(spark, d, "documents").filter("length(text) > 0").select(F.col("doc_id").alias("document_id"), F.lit("T").alias("title"), F.regexp_replace("text", "[#`~]", " ").alias("text"))
    chunks = retrieval.chunk(docs, lambda t: 1 if len(t) > 3 else 0, 1)
    vectors = retrieval.embed(chunks, lambda texts: [[float(len(t) % 7), 1.0] for t in texts], 2)
    return vectors.filter("problem IS NULL").select("document_id", F.get("embedding", F.lit(0)).cast("double").alias("first"))


@query("""SELECT CASE WHEN vec_id % 10 = 0 THEN 'embed' END AS plan, vec_id AS chunk_id FROM embeddings WHERE vec_id % 10 = 0""")
def index_plan(spark: SparkSession, d: str) -> DataFrame:
    """After a change of sources only inputs that aren't indexed are embedded; the state is read back from its file."""
    identity = {"model": "m", "revision": "1", "dimensions": 64, "max_tokens": 10, "chunker": "c"}
    chunks = V.read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.sha2(F.col("vec_id").cast("string"), 256).alias("input_sha256"))
    path = shared_dir(spark, "index")
    old = chunks.filter("chunk_id % 10 <> 0")
    retrieval.write_index(old, spark.createDataFrame([{**identity, "fingerprint": "old", "rows": 0}]), path, "v1")
    kind, todo = retrieval.plan_index(chunks, *retrieval.read_index(spark, path), identity, "new")
    return todo.select(F.lit(kind).alias("plan"), "chunk_id")


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 'c' ELSE 'a' END AS body FROM embeddings WHERE vec_id % 7 <> 0")
def index_versions(spark: SparkSession, d: str) -> DataFrame:
    """Three versions of an index, the second of which is written but not committed; readers get the third, from the data that it names."""
    path, rows = shared_dir(spark, "index"), V.read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("a").alias("body"))
    state = spark.createDataFrame([{"model": "m", "rows": 0}])
    retrieval.write_index(rows, state, path, "v1")
    versions.write_data(rows.withColumn("body", F.lit("b")), path)
    before, _ = retrieval.read_index(spark, path)
    retrieval.write_index(before.filter("chunk_id % 7 <> 0").withColumn("body", F.when(F.col("chunk_id") % 3 == 0, "c").otherwise(F.col("body"))), state, path, "v3")
    versions.prune(spark, path, 1)
    return retrieval.read_index(spark, path)[0]


@query("""SELECT o_orderkey AS transaction_id, o_custkey AS client_id, CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS amount_minor, ['PLN', 'EUR', 'USD'][CAST(o_custkey % 3 + 1 AS INTEGER)] AS currency FROM orders""")
def relational_load(spark: SparkSession, d: str) -> DataFrame:
    """Payments loaded into the database in Spark's own jars, twice, the second time with some other amounts, and read back by ranges."""
    url = f"jdbc:derby:{shared_dir(spark, 'db').removeprefix('file:').replace('///', '/')};create=true"
    rows = V.payments(spark, d).select("transaction_id", "client_id", "amount_minor", "currency")
    again = rows.filter("transaction_id % 5 = 0 OR transaction_id % 3 = 0").withColumn("amount_minor", F.col("amount_minor") + F.when(F.col("transaction_id") % 5 == 0, 1).otherwise(0))
    for table in (rows, again):
        relational.load(table, url, "payments", "transaction_id", {"currency": "VARCHAR(3)"})
    return relational.read(spark, url, "payments", "transaction_id")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits for every question, made of the order lines."""
    li = V.read(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("question_id"), F.concat(F.lit("D"), (F.col("l_partkey") % 50).cast("string")).alias("document_id"), F.concat(F.lit("C"), "l_linenumber").alias("chunk_id"), F.col("l_linenumber").cast("int").alias("rank"), (F.col("l_linenumber") / 64).cast("double").alias("similarity"), F.concat(F.lit("text "), "l_suppkey").alias("text"))


@query("SELECT l_orderkey AS question_id, string_agg(DISTINCT 'D' || (l_partkey % 50), ',' ORDER BY 'D' || (l_partkey % 50)) AS sources FROM lineitem GROUP BY 1")
def hit_sources(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hit_sources(_hits(spark, d), "question_id").withColumn("sources", F.array_join("sources", ","))


@query("""WITH h AS (SELECT l_orderkey AS q, l_linenumber AS r, 'Source: {"document_id":"D' || (l_partkey % 50) || '","chunk_id":"C' || l_linenumber || '"}' || chr(10) || 'text ' || l_suppkey AS t FROM lineitem)
  SELECT q AS question_id, string_agg(t, chr(10) || chr(10) ORDER BY r, t) AS result FROM h GROUP BY q""")
def rendered_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits as text; similarities, which engines write differently, are taken out."""
    found = retrieval.render_hits(_hits(spark, d), "question_id")
    return found.select("question_id", F.regexp_replace("result", ',"similarity":[-+.0-9E]+', "").alias("result"))


@query("""WITH g AS (SELECT l_orderkey AS q, list_distinct(list('D' || (l_partkey % 50))) AS got FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), r AS (SELECT o_orderkey AS q, list_distinct(['D' || (o_custkey % 50), 'D' || (o_orderkey % 50)]) AS want FROM orders)
  SELECT q AS question_id, round(len(list_filter(want, lambda x: list_contains(coalesce(got, []), x))) / CAST(len(want) AS DOUBLE), 6) AS recall FROM r LEFT JOIN g USING (q)""")
def recall_at_3(spark: SparkSession, d: str) -> DataFrame:
    o = V.read(spark, d, "orders")
    want = F.array_distinct(F.array(F.concat(F.lit("D"), (F.col("o_custkey") % 50).cast("string")), F.concat(F.lit("D"), (F.col("o_orderkey") % 50).cast("string"))))
    return retrieval.recall_at_k(_hits(spark, d), o.select(F.col("o_orderkey").alias("question_id"), want.alias("relevant_document_ids")), 3)


# --- evaluation -------------------------------------------------------------------------------


def _values(spark: SparkSession, d: str) -> DataFrame:
    """A letter and, for some documents, a word to look for."""
    docs = V.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    return docs.withColumn("kind", F.lit("letter")).withColumn("value", F.lit("q")).unionByName(docs.filter("document_id % 2 = 0").withColumn("kind", F.lit("word")).withColumn("value", F.lit("en")))


@query("""WITH v AS (SELECT doc_id, text, 'letter' AS kind, 'q' AS value FROM documents UNION ALL SELECT doc_id, text, 'word', 'en' FROM documents WHERE doc_id % 2 = 0), p AS (SELECT doc_id, kind, value, text, unnest(range(1, length(text) + 1)) AS i FROM v WHERE contains(text, value))
  SELECT doc_id AS document_id, kind, CAST(i - 1 AS INTEGER) AS start, CAST(i - 1 + length(value) AS INTEGER) AS "end" FROM p WHERE substr(text, i, length(value)) = value""")
def annotated_spans(spark: SparkSession, d: str) -> DataFrame:
    """All places of the values; neither can overlap itself."""
    docs = V.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return corpus.annotate_spans(docs, _values(spark, d)).select("document_id", F.inline("spans")).drop("value")


_WORDS = "[\\p{L}\\p{M}]+"


@query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORDS}')) AS value FROM benchmark), n AS (SELECT doc_id, length(value) AS letters, (length(text) - length(replace(text, value, ''))) // length(value) AS places FROM documents, w WHERE contains(text, value))
  SELECT d.doc_id AS document_id, CAST(coalesce(sum(places), 0) AS BIGINT) AS spans, count(places) AS "values", CAST(coalesce(sum(places * letters), 0) AS BIGINT) AS letters FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1""")
def annotated_words(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the benchmark wherever it stands in a document, found by one automaton."""
    values = V.read(spark, d, "benchmark").select(F.lit("word").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0))).alias("value"))
    found = corpus.annotate_spans(V.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text"), values)
    letters = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("document_id", F.size("spans").cast("long").alias("spans"), F.size(F.array_distinct(F.transform("spans", lambda s: s["value"]))).cast("long").alias("values"), letters.alias("letters"))


@query("""WITH b AS (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark)), p AS (SELECT w[i] AS a, w[i + 1] AS z, min(item_id * 100000 + i) AS place FROM b GROUP BY 1, 2),
  f AS (SELECT a, z, row_number() OVER (ORDER BY place) - 1 AS rank FROM p), t AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+|\\s+|[^\\p{L}\\p{N}_\\s]+') AS w FROM documents)),
  h AS (SELECT doc_id, min(rank) AS rank FROM t JOIN f ON a = w[i] AND z = w[i + 2] AND regexp_full_match(w[i + 1], '\\s+') WHERE rank < 500 GROUP BY 1)
  SELECT 'd' || doc_id AS request_id, 'block' AS verdict, 'other' AS category, 'signature W-' || rank || ' (other): two words' AS reason FROM h""".replace("\\\\", "\\"))
def scan_long_feed(spark: SparkSession, d: str) -> DataFrame:
    """A feed of 500 signatures: words of the benchmark that follow each other."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))
    pairs = V.read(spark, d, "benchmark").select("item_id", words.alias("w")).select("item_id", F.posexplode(F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("a"), F.get("w", i + 1).alias("z")))).alias("i", "p"))
    first = pairs.groupBy("p").agg(F.min(F.col("item_id") * 100000 + F.col("i")).alias("place")).orderBy("place").limit(500).collect()  # the feed's length
    feed = [(f"W-{n}", "other", "two words", rf"\b{r.p.a}\s+{r.p.z}\b", False) for n, r in enumerate(first)]
    texts = V.read(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("request_id"), F.lit(0).alias("message_index"), F.col("text").alias("content"))
    return scans.scan_signatures(texts, feed)


_PLACES = """places AS (SELECT doc_id, i - 1 AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE contains(text, 'en')) WHERE substr(text, i, 2) = 'en')"""


def _truth(spark: SparkSession, d: str) -> DataFrame:
    docs = V.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return corpus.annotate_spans(docs, docs.select("document_id", F.lit("word").alias("kind"), F.lit("en").alias("value"))).select("document_id", F.inline("spans"))


@query(f"WITH {_PLACES} SELECT doc_id AS document_id, CAST(s + CASE WHEN s % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS start FROM places WHERE s % 3 = 0")
def wrong_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every third place is shifted by one, which the check finds."""
    docs = V.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    shift = F.when(F.col("start") % 3 == 0, 1).otherwise(0)
    spans = _truth(spark, d).withColumn("end", F.col("end") + shift).withColumn("start", F.col("start") + shift)
    return corpus.check_spans(docs, spans).select("document_id", "start")


@query(f"WITH {_PLACES} SELECT 'word' AS kind, count(*) AS spans, count(*) FILTER (WHERE s % 2 = 0) AS covered, round(count(*) FILTER (WHERE s % 2 = 0) / CAST(count(*) AS DOUBLE), 6) AS recall FROM places")
def detection_recall(spark: SparkSession, d: str) -> DataFrame:
    truth = _truth(spark, d).drop("value")
    found = truth.filter("start % 2 = 0").withColumn("start", F.col("start") - 1).withColumn("end", F.col("end") + 2)
    return corpus.detection_report(found, truth)


@query("SELECT CASE WHEN quality = 1 THEN 'clean' ELSE 'poisoned' END AS variant, count(*) AS documents, count(*) FILTER (WHERE doc_id % 4 = 0) AS flagged FROM labels GROUP BY 1")
def flagged_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = V.read(spark, d, "labels")
    flags = rows.filter("doc_id % 3 <> 0 OR doc_id % 4 = 0").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 4 == 0).alias("flagged"))
    return corpus.flag_report(flags, rows.select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "clean").otherwise("poisoned").alias("variant")))


@query("""WITH o AS (SELECT doc_id AS k, CASE WHEN n_chars > 2000 THEN 'block' ELSE 'allow' END AS action, CASE WHEN n_chars > 2000 THEN source END AS b, coalesce(lang, '') AS reason FROM documents),
  e AS (SELECT doc_id AS k, CASE WHEN quality = 1 THEN 'allow' ELSE 'block' END AS action, CASE WHEN doc_id % 2 = 0 THEN 'web' END AS b, CASE WHEN doc_id % 3 = 0 THEN 'e' END AS r FROM labels)
  SELECT * FROM (SELECT coalesce(o.k, e.k) AS "case", concat_ws(',', CASE WHEN o.k IS NULL THEN 'missing outcome' END, CASE WHEN e.k IS NULL THEN 'unexpected case' END, CASE WHEN o.action <> e.action THEN 'action' END,
    CASE WHEN e.b IS NOT NULL AND o.b IS DISTINCT FROM e.b THEN 'blocked_by' END, CASE WHEN e.r IS NOT NULL AND NOT coalesce(contains(o.reason, e.r), false) THEN 'reason' END) AS differs FROM o FULL JOIN e ON o.k = e.k) WHERE differs <> ''""")
def conformance_reasons(spark: SparkSession, d: str) -> DataFrame:
    long = F.col("n_chars") > 2000
    got = V.read(spark, d, "documents").select(F.col("doc_id").alias("case"), F.when(long, "block").otherwise("allow").alias("action"), F.when(long, F.col("source")).alias("blocked_by"), F.coalesce("lang", F.lit("")).alias("reason"))
    want = V.read(spark, d, "labels").select(F.col("doc_id").alias("case"), F.when(F.col("quality") == 1, "allow").otherwise("block").alias("action"), F.when(F.col("doc_id") % 2 == 0, "web").alias("blocked_by"), F.when(F.col("doc_id") % 3 == 0, "e").alias("reason_contains"))
    return decisions.conformance(got, want)


@query("SELECT 'customer' AS \"table\", count(*) AS rows FROM customer UNION ALL SELECT 'documents', count(*) FROM documents")
def export_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Exported tables, their bodies apart, counted again from the files against the manifest."""
    path = shared_dir(spark, "corpus")
    docs = V.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text", "source")
    files.export_corpus({"customer": V.read(spark, d, "customer"), "documents": docs}, path)
    manifest = spark.read.json(f"{path}/manifest").select("table", F.col("rows").alias("expected"))
    found = corpus.table_counts({"customer": spark.read.json(f"{path}/customer"), "documents": spark.read.json(f"{path}/documents").join(spark.read.parquet(f"{path}/texts"), "document_id")}, manifest)
    return found.filter("agrees").select("table", "rows")


@query("SELECT l_orderkey AS document_id, l_partkey AS transaction_id FROM lineitem GROUP BY 1, 2")
def document_links(spark: SparkSession, d: str) -> DataFrame:
    """Lists of payments to a link table."""
    docs = V.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("transaction_ids"), F.lit("c").alias("client_id"))
    return corpus.document_links(docs).select("document_id", "transaction_id")
