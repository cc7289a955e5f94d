"""Corpus tables as JSON lines with Markdown bodies beside them, exports with a manifest, and relational loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from . import relational

TABLES = {"clients": S.CLIENTS, "contacts": S.CONTACTS, "accounts": S.ACCOUNTS, "transactions": S.TRANSACTIONS}


def read_corpus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables below path; documents get their text from the Markdown file that their path column names."""
    tables = {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in TABLES.items()}
    rows = spark.read.schema(S.DOCUMENTS + ", path string").json(f"{path}/documents")
    bodies = spark.read.text(f"{path}/bodies", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "bodies/(.*)$", 1).alias("path"), F.col("value").alias("text"))
    return {**tables, "documents": rows.join(bodies, "path", "left").drop("path")}


def export_corpus(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write every table, document texts apart from their rows; returns the manifest (table, rows, sha256)."""
    parts = []
    for name, table in tables.items():
        if name == "documents":
            table.select("document_id", "text").write.parquet(f"{path}/texts")
            table = table.drop("text")
        table.write.json(f"{path}/{name}")
        row = F.sha2(F.to_json(F.struct(*sorted(table.columns))), 256)
        parts.append(table.select(row.alias("h")).agg(F.count("*").alias("rows"), F.sha2(F.coalesce(F.bit_xor(F.xxhash64("h")).cast("string"), F.lit("")), 256).alias("sha256")).select(F.lit(name).alias("table"), "rows", "sha256"))
    manifest = parts[0]
    for p in parts[1:]:
        manifest = manifest.unionByName(p)
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return manifest


#: Key and text columns of the tables in a relational store.
KEYS = {"clients": "client_id", "contacts": "contact_id", "accounts": "account_id", "transactions": "transaction_id", "documents": "document_id", "document_transactions": "document_id"}


def load_jdbc(tables: dict[str, DataFrame], url: str, types: dict[str, dict[str, str]] | None = None, **options) -> None:
    """Load the tables into a relational store, each in a transaction that replaces the keys that it has; document links go to a table of their own."""
    from ..operators.corpus import document_links

    todo = dict(tables)
    if "documents" in todo:
        todo["document_transactions"] = document_links(todo["documents"])
        todo["documents"] = todo["documents"].drop("transaction_ids")
    for name, table in todo.items():
        relational.load(table, url, name, KEYS.get(name, table.columns[0]), (types or {}).get(name), **options)
