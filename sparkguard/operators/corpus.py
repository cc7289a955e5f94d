"""Clients, accounts, payments and documents: integrity, links, totals and labelled spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.patterns import Values
from ..session import bound_batches


def document_links(documents: DataFrame) -> DataFrame:
    """document_id, transaction_id, client_id: one row per link."""
    return documents.select("document_id", F.explode("transaction_ids").alias("transaction_id"), "client_id")


def linked_payments(documents: DataFrame, links: DataFrame) -> DataFrame:
    """documents with the sorted list of their linked payments; empty where there are none."""
    lists = links.groupBy("document_id").agg(F.array_sort(F.collect_list("transaction_id")).alias("linked"))
    return documents.join(lists, "document_id", "left").withColumn("linked", F.coalesce("linked", F.array().cast(lists.schema["linked"].dataType)))


def orphans(rows: DataFrame, owners: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Problem rows for each row whose non-null keys aren't among the owners'."""
    known = rows.filter(F.concat_ws("", *[F.col(k).cast("string") for k in keys]) != "")
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    missing = known.join(owners.select(*keys).distinct(), keys, "left_anti")
    return missing.groupBy(*keys).agg(F.count("*").alias("rows")).select(F.lit(name).alias("problem"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"), "rows")


def duplicates(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1").select(F.lit(name).alias("problem"), F.col(key).cast("string").alias("key"), "rows")


def incomplete_pairs(truth: DataFrame) -> DataFrame:
    """Pairs that aren't exactly one clean and one poisoned document of one client."""
    pairs = truth.filter("pair_id IS NOT NULL").groupBy("pair_id").agg(F.count("*").alias("rows"), F.array_sort(F.collect_set("variant")).alias("variants"), F.count_distinct("client_id").alias("clients"))
    wrong = (F.col("rows") != 2) | (F.col("variants") != F.array(F.lit("clean"), F.lit("poisoned"))) | (F.col("clients") > 1)
    return pairs.filter(wrong).select(F.lit("incomplete pair").alias("problem"), F.col("pair_id").cast("string").alias("key"), "rows")


def validate_corpus(tables: dict[str, DataFrame]) -> DataFrame:
    """problem, key, rows of all integrity faults; no row: the corpus is sound."""
    t = tables
    checks = [
        duplicates(t["clients"], "client_id", "duplicate client"),
        duplicates(t["accounts"], "account_id", "duplicate account"),
        duplicates(t["transactions"], "transaction_id", "duplicate payment"),
        duplicates(t["documents"], "document_id", "duplicate document"),
        orphans(t["accounts"], t["clients"], ["client_id"], "account without client"),
        orphans(t["transactions"], t["clients"], ["client_id"], "payment without client"),
        orphans(t["transactions"], t["accounts"], ["account_id", "client_id", "currency"], "payment does not fit account"),
        orphans(t["documents"], t["clients"], ["client_id"], "document without client"),
        orphans(document_links(t["documents"]), t["transactions"], ["transaction_id", "client_id"], "link does not fit payment"),
    ]
    if "contacts" in t:
        checks.append(orphans(t["contacts"], t["clients"], ["client_id"], "contact without client"))
    if "truth" in t:
        checks += [incomplete_pairs(t["truth"]), duplicates(t["truth"], "document_id", "duplicate truth"), orphans(t["documents"].select("document_id"), t["truth"], ["document_id"], "document without truth")]
    if "questions" in t:
        targets = t["questions"].select("question_id", F.explode("relevant_document_ids").alias("document_id"))
        checks.append(orphans(targets, t["documents"], ["document_id"], "question target without document"))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def find_payments(payments: DataFrame, client_id=None, transaction_id=None, status: str | None = None) -> DataFrame:
    for name, value in (("client_id", client_id), ("transaction_id", transaction_id), ("status", status)):
        if value is not None:
            payments = payments.filter(F.col(name) == value)
    return payments


def payment_page(payments: DataFrame, limit: int = 20) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    return payments.orderBy("booked_at", "transaction_id").limit(limit)


def payment_totals(payments: DataFrame) -> DataFrame:
    """Per currency over all matches: count, credits, debits."""
    side = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount_minor"))), F.lit(0)).alias(d)
    return payments.groupBy("currency").agg(F.count("*").alias("payments"), side("credit"), side("debit"))


def liquidity(accounts: DataFrame, payments: DataFrame) -> DataFrame:
    """account_id, currency, balance_minor: opening plus settled credits less settled debits, in whole minor units."""
    signed = F.when(F.col("direction") == "credit", F.col("amount_minor")).otherwise(-F.col("amount_minor"))
    moved = payments.filter("status = 'settled'").groupBy("account_id").agg(F.sum(signed).alias("moved"))
    return accounts.join(moved, "account_id", "left").select("account_id", "currency", (F.col("opening_balance_minor") + F.coalesce("moved", F.lit(0))).alias("balance_minor"))


def table_counts(tables: dict[str, DataFrame], manifest: DataFrame | None = None) -> DataFrame:
    """table, rows; with a manifest(table, expected) also whether they agree."""
    parts = [t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if manifest is None else out.join(F.broadcast(manifest), "table", "full_outer").withColumn("agrees", F.col("rows").eqNullSafe(F.col("expected")))


def table_differences(stored: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with multiplicity."""
    return stored.exceptAll(source).withColumn("only_in", F.lit("stored")).unionByName(source.exceptAll(stored).withColumn("only_in", F.lit("source")))


def inventory_differences(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """found and manifest (path, sha256): files that are missing, unexpected or changed."""
    joined = found.alias("f").join(manifest.alias("m"), F.col("f.path") == F.col("m.path"), "full_outer")
    state = F.when(F.col("m.path").isNull(), "unexpected").when(F.col("f.path").isNull(), "missing").when(F.col("f.sha256") != F.col("m.sha256"), "changed")
    return joined.select(F.coalesce("f.path", "m.path").alias("path"), state.alias("state")).filter("state IS NOT NULL")


def find_clients(clients: DataFrame, name: str | None = None, client_id=None) -> DataFrame:
    if name:
        clients = clients.filter(F.contains(F.lower("name"), F.lit(name.lower())))
    return clients if client_id is None else clients.filter(F.col("client_id") == client_id)


_PLACES = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("value", StringType())]))


#: Bytes of known values in one automaton; more are looked for in as many passes.
VALUE_BYTES = 16 << 20


#: Spans that a task turns into columns at a time; a single text may have more.
SPANS = 1 << 16


def annotate_spans(documents: DataFrame, values: DataFrame, overlapping: bool = False) -> DataFrame:
    """documents(document_id, text) with spans of the places of values(kind, value), which don't overlap others of the same value unless overlapping.

    Values with a document_id are those of a document, else they are known for all: one automaton, sent to the tasks once.
    """
    if "document_id" in values.columns:
        lists = values.groupBy("document_id").agg(F.collect_list(F.struct("kind", "value")).alias("_values"))
        own = lambda wanted: Values((p["value"], p["kind"]) for p in wanted or ())
        return _with_spans(documents.join(lists, "document_id", "left"), "spans", own, overlapping, "_values").drop("_values")
    known = values.select("kind", "value").distinct()
    size = known.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()[0]
    blocks, found = max(1, -(-size // VALUE_BYTES)), documents
    for b in range(blocks):
        pairs = [(r.value, r.kind) for r in known.filter(f"pmod(xxhash64(value), {blocks}) = {b}").collect()]  # bounded by VALUE_BYTES
        shared = documents.sparkSession.sparkContext.broadcast(Values(pairs))
        found = _with_spans(found, f"_spans{b}", lambda _, shared=shared: shared.value, overlapping)
    parts = [f"_spans{b}" for b in range(blocks)]
    return found.withColumn("spans", F.array_sort(F.flatten(F.array(*parts)), _by_place) if blocks > 1 else F.col(parts[0])).drop(*parts)


def _by_place(a, b):
    key = lambda s: F.struct(s["start"], s["end"], s["kind"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def _with_spans(documents: DataFrame, name: str, values_of, overlapping: bool, wanted: str | None = None) -> DataFrame:
    """documents with the places of values_of(wanted), a few texts at a time."""
    columns = documents.columns
    at, own = columns.index("text"), columns.index(wanted) if wanted else None

    def spans(found: list[tuple]) -> pa.Array:
        words, kinds = (pa.chunked_array([getattr(v, n).take(pa.array(p[k])) for v, p in found], pa.string()).combine_chunks() for n, k in (("words", 2), ("kinds", 3)))
        start, end = (pa.array(np.concatenate([p[k] for _, p in found]).astype(np.int32)) for k in (0, 1))
        ends = pa.array(np.cumsum([0, *(p.shape[1] for _, p in found)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([kinds, start, end, words], _PLACES.elementType.names))

    def work(batches):
        asked, values = None, values_of(None)
        for batch in batches:
            first, n, found = 0, 0, []
            lists = batch.column(own).to_pylist() if own is not None else [None] * batch.num_rows
            for i, (text, wants) in enumerate(zip(batch.column(at).to_pylist(), lists, strict=True)):
                if wants != asked:
                    asked, values = wants, values_of(wants)
                found.append((values, values.places(text, overlapping)))
                n += found[-1][1].shape[1]
                if n >= SPANS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, i + 1 - first).columns, spans(found)], [*columns, name])
                    first, n, found = i + 1, 0, []

    return bound_batches(documents).mapInArrow(work, StructType([*documents.schema.fields, StructField(name, _PLACES)]))


def check_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """spans(document_id, kind, start, end, value) that don't hold what the text has there, or are empty."""
    joined = spans.join(documents.select("document_id", "text"), "document_id", "left")
    held = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return joined.filter((F.col("end") <= F.col("start")) | ~held.eqNullSafe(F.col("value"))).drop("text")


def detection_report(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Per kind how many true spans a found span of the document covers; both (document_id, kind, start, end)."""
    t = truth.withColumn("truth_id", F.xxhash64("document_id", "kind", "start", "end"))
    hit = t.alias("t").join(found.alias("f"), (F.col("t.document_id") == F.col("f.document_id")) & (F.col("f.start") <= F.col("t.start")) & (F.col("f.end") >= F.col("t.end")))
    covered = hit.select(F.col("t.truth_id").alias("truth_id"), F.lit(True).alias("hit")).distinct()
    return t.join(covered, "truth_id", "left").groupBy("kind").agg(F.count("*").alias("spans"), F.count("hit").alias("covered")).withColumn("recall", F.col("covered") / F.col("spans"))


def flag_report(flags: DataFrame, truth: DataFrame) -> DataFrame:
    """flags(document_id, flagged) against truth(document_id, variant): documents and flagged ones per variant."""
    joined = truth.join(flags, "document_id", "left")
    return joined.groupBy("variant").agg(F.count("*").alias("documents"), F.count_if(F.coalesce("flagged", F.lit(False))).alias("flagged"))


