"""A training-corpus pipeline of five stages; each stage's rows are written as Parquet and read again by the next.

Every stage but the last returns the columns of documents. Columns beside doc_id and text, whatever their names and types,
pass through unread; n_chars follows the text where secrets are hidden. Rows with a null doc_id are kept by near-duplicate
removal, which decides by doc_id, and judged by their texts in all other stages. Null and empty texts are dropped by the first
stage and pass the others. Texts of any length are read whole, ties and repeated rows are as each stage says, and empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkguard.llm import config_packing, decontamination, langid, near_dedup, secret_scan
from sparkguard.llm.common import materialize, read, sized


#: Share of a document's letters (by their UTF-8 bytes, as label_spans() scores) that the spans of one language hold at least.
MIN_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those in which no language holds MIN_SCORE of the letters.

    Null and empty texts have no letter. Where no row has a label to learn from, all documents with a letter stay.
    """
    model = langid.train(docs.filter(~langid.held_out()))
    if not model.labels:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no column clashes with the operator's
    found = langid.label_spans(plain, model, text=f"c{names.index('text')}", keep=tuple(plain.columns))
    return found.filter(F.expr("lang_pred <> 'und'") & (F.col("score") >= MIN_SCORE)).select(plain.columns).toDF(*names)


def _without(docs: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """docs but for those whose key is in bad; texts are only shuffled where the keys are too many for a broadcast."""
    return docs.join(sized(materialize(bad.select(key).distinct(), "dropped")), key, "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates keep the document with the smallest doc_id.

    Rows that share a doc_id are one document: of those with equal texts one stays, unlike texts all do.
    """
    names = docs.columns
    copies = near_dedup.near_duplicates(docs).filter("NOT kept").select("doc_id")
    kept = materialize(_without(docs, copies, "doc_id").select(names), "kept")
    shared = sized(materialize(kept.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "shared"))
    again = kept.join(shared, "doc_id", "left_semi").select(names)
    text = "t" * (max(map(len, names)) + 1)  # a name that no column has
    one = again.withColumn(text, F.sha2("text", 256)).dropDuplicates(["doc_id", text]).select(names)
    return kept.join(shared, "doc_id", "left_anti").select(names).unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; rows that share a doc_id, or have none, are each judged by their text."""
    key = "k" * (max(map(len, docs.columns)) + 1)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    leaks = decontamination.contamination(keyed.select(F.col(key).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return _without(keyed, leaks.select(F.col("doc_id").alias(key)), key).select(docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every reported secret; all documents stay."""
    hidden = secret_scan.redact(docs)
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else hidden


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 4096 tokens."""
    return config_packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", hide_secrets),
    ("packing", pack_sequences),
]
#: Language identification, near-duplicate classes and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
