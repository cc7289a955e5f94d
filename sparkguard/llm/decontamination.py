"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Words are runs of letters and digits of the lower-cased text, shingles are five words; an item of one to four words is one shingle of that
length, for which documents are probed as well. Items are partitioned by size
(powers of two of their number of distinct shingles). A partition with at most u shingles sketches each item by its
floor((1 - LEAST) * u) + 1 smallest shingle hashes: a document that holds at least LEAST of an item's shingles lacks too
few to miss all of them, so the search loses nothing, however long the document is. Documents probe the sketches with
the hashes of all their shingles; candidates are verified by the exact share of the item's shingles in the document.

Candidates are few, so documents are filtered by them where they are read and no text is shuffled; only where they are too
many for a broadcast are they joined by a shuffle.

Nulls and texts without a word have no shingles and never match. Rows with a null doc_id or item_id take no part.
Repeated rows and rows that share a doc_id or an item_id give one row per (doc_id, item_id), of the texts with the greatest
containment; ties go to the longer item. Very long texts are searched whole. Empty tables give no rows. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized

WORDS, LEAST = 5, 0.8


def words_of(text: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(words: str, k: Column | int = WORDS) -> Column:
    """Distinct shingles of an array of words; null where there are fewer than k."""
    k = k if isinstance(k, Column) else F.lit(k)
    each = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(F.size(words) >= k, F.array_distinct(each))


def shingle_hashes(words: str, k: Column | int = WORDS) -> Column:
    k = k if isinstance(k, Column) else F.lit(k)
    each = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))
    return F.when(F.size(words) >= k, each)


def item_length(words: str = "words") -> Column:
    """Words of an item's shingles."""
    return F.least(F.size(words), F.lit(WORDS))


def sketches(items: DataFrame, least: float = LEAST) -> DataFrame:
    """(item_id, hash) rows: the smallest hashes of each item, as many as its size partition needs."""
    sized = items.withColumn("hashes", F.array_sort(F.array_distinct(shingle_hashes("words", item_length())))).filter("hashes IS NOT NULL")
    upper = F.pow(2, F.ceil(F.log2(F.size("hashes")))).cast("int")
    keep = (F.floor(F.lit(1 - least) * upper + F.lit(1e-9)) + 1).cast("int")
    return sized.select("item_id", F.explode(F.slice("hashes", F.lit(1), F.least(keep, F.size("hashes")))).alias("hash")).distinct()


def contamination(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of each document that holds at least least of an item."""
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    items = items.filter("item_id IS NOT NULL").select("item_id", words_of().alias("words")).filter("size(words) > 0")
    lengths = sorted(r.k for r in items.select(item_length().alias("k")).distinct().collect()) or [WORDS]  # of 1 to WORDS
    sketch = sized(materialize(sketches(items, least), "sketches"))
    none = F.array().cast("array<bigint>")
    probe = docs.select("doc_id", words_of().alias("words")).select("doc_id", F.explode(F.concat(*[F.coalesce(shingle_hashes("words", k), none) for k in lengths])).alias("hash"))
    candidates = sized(materialize(probe.join(sketch, "hash").select("doc_id", "item_id").distinct(), "candidates"))
    exact = items.select("item_id", item_length().alias("k"), shingles("words", item_length()).alias("of_item"))
    exact = sized(materialize(exact.withColumn("joined", F.array_join("of_item", " ")), "shingles"), "joined").drop("joined")
    texts = docs.join(candidates, "doc_id").withColumn("words", words_of()).join(exact, "item_id")
    counted = texts.select("doc_id", "item_id", F.size("of_item").cast("long").alias("n_shingles"), F.size(F.array_intersect("of_item", shingles("words", F.col("k")))).cast("long").alias("n_shared"))
    # the threshold comes after the aggregation: below it, it would evaluate the shingles once more for every reference
    best = counted.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.expr("n_shared / n_shingles AS containment"), "n_shingles", "n_shared")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_shingles", "m.n_shared", "m.containment").filter(F.col("n_shared") >= F.col("n_shingles") * least - 1e-9)


ORACLE_SQL = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
ik AS (SELECT item_id, w, least(len(w), {WORDS}) AS k FROM iw WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM ik))),
its AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ik)),
n AS (SELECT item_id, count(*) AS n_shingles FROM its GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN its USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, CAST(n_shared AS DOUBLE) / n_shingles AS containment
FROM shared JOIN n USING (item_id) WHERE n_shared >= n_shingles * {LEAST} - 1e-9"""
