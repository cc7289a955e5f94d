"""Chunks, vectors and search over document corpora."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import takewhile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..session import bound_batches
from ..sources import versions
from .fingerprints import source_fingerprint as source_fingerprint
from .keywords import keyword_top_k

_HEADING = re.compile(r" {0,3}(#{1,6})[ \t]+(\S.*)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_CHUNK = ArrayType(StructType([StructField("chunk_index", IntegerType()), StructField("section_path", ArrayType(StringType())), StructField("char_start", IntegerType()), StructField("char_end", IntegerType()), StructField("text", StringType()), StructField("embedding_input", StringType()), StructField("token_count", IntegerType()), StructField("error", StringType())]))


def sections(text: str) -> list[tuple[list[str], int, int]]:
    """(heading path, start, end) of Markdown sections; headings inside fenced blocks are text. The ranges cover the text."""
    cuts: list[tuple[int, list[str]]] = [(0, [])]
    above: list[tuple[int, str]] = []  # level and name of the open headings; levels may be skipped
    at, fence = 0, ""
    for line in text.splitlines(keepends=True):
        if mark := _FENCE.match(line):
            if not fence:
                fence = mark[1]
            elif mark[1].startswith(fence):
                fence = ""
        elif not fence and (heading := _HEADING.match(line)):
            level, name = len(heading[1]), heading[2].rstrip()
            closing = name.rstrip("#")
            above = [h for h in above if h[0] < level] + [(level, closing.rstrip() if closing[-1:] in (" ", "\t") else name)]
            cuts.append((at, [n for _, n in above]))
        at += len(line)
    ends = [start for start, _ in cuts[1:]] + [len(text)]
    return [(path, start, end) for (start, path), end in zip(cuts, ends, strict=True) if end > start]


def chunk_text(title: str, text: str, count_tokens, max_tokens: int) -> list[dict]:
    """Chunks within the token budget: as many whole paragraphs as fit, else as many characters. They cover the text without overlap."""
    out: list[dict] = []
    for path, start, end in sections(text):
        prefix = "\n".join([title, " > ".join(path)] if path else [title]) + "\n\n"
        if count_tokens(prefix) >= max_tokens:
            raise ValueError("the heading path exceeds the token budget")
        fits = lambda a, b, p=prefix: count_tokens(p + text[a:b]) <= max_tokens
        breaks = [start + m.end() for m in re.finditer(r"\n[ \t]*\n", text[start:end])]
        breaks = [b for b in breaks if b < end] + [end]
        while start < end:
            ahead = [end] if fits(start, end) else breaks[bisect_right(breaks, start) :]
            stop = max(takewhile(lambda b, a=start: fits(a, b), ahead), default=start)
            if stop == start:  # a paragraph that doesn't fit: the longest part of it that does
                stop += bisect_left(range(start + 1, ahead[0] + 1), True, key=lambda b, a=start: not fits(a, b))
                if stop == start:
                    raise ValueError("one character exceeds the token budget")
            body = text[start:stop]
            out.append({"chunk_index": len(out), "section_path": path, "char_start": start, "char_end": stop, "text": body, "embedding_input": prefix + body, "token_count": count_tokens(prefix + body), "error": None})
            start = stop
    return out


def chunk(documents: DataFrame, count_tokens, max_tokens: int) -> DataFrame:
    """documents(document_id, title, text) to chunk rows with source and input hashes; a failing document gives one row with its error."""

    @F.pandas_udf(_CHUNK)
    def cut(title: pd.Series, text: pd.Series) -> pd.Series:
        def one(a, b):
            try:
                return chunk_text(a or "", b or "", count_tokens, max_tokens)
            except ValueError as e:
                return [{**dict.fromkeys(_CHUNK.elementType.names), "chunk_index": 0, "error": str(e)}]

        return pd.Series([one(a, b) for a, b in zip(title, text, strict=True)])

    rows = bound_batches(documents).withColumn("source_sha256", F.sha2("text", 256)).withColumn("c", F.explode(cut("title", "text")))
    kept = rows.select("document_id", "source_sha256", "c.*")
    return kept.withColumn("chunk_id", F.format_string("%s:C%04d", F.col("document_id").cast("string"), F.col("chunk_index"))).withColumn("input_sha256", F.sha2("embedding_input", 256))


def h2_sections(documents: DataFrame) -> DataFrame:
    """document_id, position, section: a text split before its second-level headings."""
    return documents.select("document_id", F.posexplode(F.split("text", r"(?m)(?=^## )")).alias("position", "section")).filter("trim(section) <> ''")


def validate_vectors(vectors: DataFrame, dimension: int) -> DataFrame:
    """vectors with problem: dimension, null or non-finite component, all zero; null: fine."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    problem = F.when(v.isNull() | (F.size(v) != dimension), "dimension").when(bad, "not finite").when(~F.exists(v, lambda x: x != 0), "all zero")
    return vectors.withColumn("problem", problem)


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, z: acc + z)
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def visible(chunks: DataFrame, documents: DataFrame, client_id) -> DataFrame:
    """Chunks of a client's documents and of public guides; two branches, so each is an equi-join with pushed filters."""
    own = documents.filter(F.col("client_id") == client_id)
    public = documents.filter(F.col("client_id").isNull() & (F.col("classification") == "public"))
    scope = own.unionByName(public).select("document_id", "client_id")
    return chunks.join(scope, "document_id")


def search(chunks: DataFrame, query: list[float], k: int, links: DataFrame | None = None, transaction_id=None) -> DataFrame:
    """The k chunks nearest to one query, of documents that are linked to a payment if one is given; ties by chunk_id."""
    if not 1 <= k <= 10:
        raise ValueError("k must be from 1 to 10")
    if transaction_id is not None:
        chunks = chunks.join(links.filter(F.col("transaction_id") == transaction_id), "document_id", "left_semi")
    vector = F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.withColumn("distance", cosine_distance(F.col("embedding"), vector))
    return scored.orderBy("distance", "chunk_id").limit(k).withColumn("similarity", 1 - F.col("distance"))


#: Bytes of query vectors that go to every task at a time, and distances that a task works on.
BROADCAST_BYTES, DISTANCES = 32 << 20, 1 << 21


def _nearest(best: tuple[np.ndarray, np.ndarray] | None, ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, chunk) of the k nearest to each query, of those so far and some more chunks; ties by chunk."""
    norms = np.linalg.norm(queries, axis=1)
    rows = max(1, DISTANCES // max(1, len(queries)))
    for lo in range(0, len(ids), rows):
        part = vectors[lo : lo + rows]
        distance = 1 - queries @ part.T / np.outer(norms, np.linalg.norm(part, axis=1))
        chunk = np.broadcast_to(ids[lo : lo + rows], distance.shape)
        if best is not None:
            distance, chunk = np.hstack((best[0], distance)), np.hstack((best[1], chunk))
        order = np.lexsort((chunk, distance))[:, :k]
        best = np.take_along_axis(distance, order, 1), np.take_along_axis(chunk, order, 1)
    return best


def search_many(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """queries(query_id, scope, embedding) against chunks(chunk_id, scope, embedding) of their scope: the k nearest each.

    Queries are broadcast as one matrix a scope, in as many passes over the chunks as their bytes need; a task multiplies its chunks with them
    and keeps the k nearest of each, which is all that is shuffled.
    """
    size = queries.agg(F.sum(F.size("embedding") * F.lit(8) + 16).alias("bytes")).first().bytes or 0
    found = chunks.sparkSession.createDataFrame([], "query_id long, chunk_id long, distance double")
    passes = -(-size // BROADCAST_BYTES)
    for p in range(passes):
        by_scope: dict = {}
        for r in queries.filter(f"pmod(xxhash64(query_id), {passes}) = {p}").select("scope", "query_id", "embedding").collect():  # bounded by BROADCAST_BYTES
            by_scope.setdefault(r.scope, []).append((r.query_id, np.asarray(r.embedding, np.float64)))
        shared = chunks.sparkSession.sparkContext.broadcast({s: ([q for q, _ in rows], np.array([v for _, v in rows])) for s, rows in by_scope.items()})
        local = chunks.select("scope", "chunk_id", "embedding").mapInArrow(_near(shared, k), "query_id long, chunk_id long, distance double")
        found = found.unionByName(local)
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("similarity", 1 - F.col("distance"))


def _near(shared, k: int):
    def work(batches):
        best: dict = {}
        for batch in batches:
            for scope, rows in batch.to_pandas().groupby("scope", sort=False):
                if scope in shared.value:
                    vectors = np.array([np.asarray(x, np.float64) for x in rows["embedding"]])
                    best[scope] = _nearest(best.get(scope), rows["chunk_id"].to_numpy(), vectors, shared.value[scope][1], k)
        for scope, (distance, chunk) in best.items():
            query = np.repeat(np.asarray(shared.value[scope][0], np.int64), distance.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(chunk.ravel().astype(np.int64)), pa.array(distance.ravel())], ["query_id", "chunk_id", "distance"])

    return work


def tokens_of(text: str) -> Column:
    """Distinct lower-case words of more than two characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\w-]+"), F.lit(0)), lambda w: F.length(w) > 2))


def keyword_search(chunks: DataFrame, query: str, k: int = 5) -> DataFrame:
    """The k chunks with the greatest word overlap, over the root of the product of both sizes."""
    spark = chunks.sparkSession
    words = spark.range(1).select(tokens_of_text(query).alias("w")).first().w
    q = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    score = F.size(F.array_intersect("words", q)) / F.sqrt(F.size("words") * F.lit(len(words)))
    scored = chunks.withColumn("words", tokens_of("text")).withColumn("score", F.round(F.when(F.size("words") * len(words) > 0, score).otherwise(0.0), 4))
    return scored.filter("score > 0").orderBy(F.desc("score"), "chunk_id").limit(k).drop("words")


def tokens_of_text(text: str) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.lit(text)), F.lit(r"(?U)[\w-]+"), F.lit(0)), lambda w: F.length(w) > 2))


def keyword_search_many(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """queries(query_id, text) at once: the k best chunks each by keyword_search()'s score, found by upper bounds."""
    return keyword_top_k(chunks, queries, tokens_of, k).select("query_id", "chunk_id", "score", "rank")


def index_report(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: documents, chunks, tokens, dimensions if chunks have vectors, and faults: texts that differ from their range, gaps or overlaps, uncovered ends."""
    dimensions = [f(F.size("embedding")).alias(n) for f, n in ((F.min, "min_dimensions"), (F.max, "max_dimensions"))] if "embedding" in chunks.columns else []
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    joined = chunks.join(documents.select("document_id", F.col("text").alias("source")), "document_id")
    rows = joined.withColumn("previous", F.coalesce(F.lag("char_end").over(w), F.lit(0))).withColumn("last", F.lead("chunk_index").over(w).isNull())
    same = F.substr("source", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("text")
    return rows.agg(
        F.count_distinct("document_id").alias("documents"),
        F.count("*").alias("chunks"),
        F.max("token_count").alias("max_tokens"),
        F.count_if(~same).alias("text_mismatches"),
        F.count_if(F.col("previous") != F.col("char_start")).alias("gaps_or_overlaps"),
        F.count_if(F.col("last") & (F.col("char_end") != F.length("source"))).alias("uncovered_ends"),
        *dimensions,
    )


IDENTITY = ("model", "revision", "dimensions", "max_tokens", "chunker")


def plan_index(chunks: DataFrame, indexed: DataFrame, state: DataFrame | None, identity: dict, fingerprint: str, rebuild: bool = False) -> tuple[str, DataFrame]:
    """("reuse" | "embed" | "rebuild", chunks to embed): all of them after another identity, else those whose input isn't indexed."""
    row = state.first() if state is not None else None
    same = row is not None and all(str(row[k]) == str(identity[k]) for k in IDENTITY)
    if rebuild or not same:
        return "rebuild", chunks
    if row["fingerprint"] == fingerprint and row["rows"] == indexed.count():
        return "reuse", chunks.limit(0)
    return "embed", chunks.join(indexed.select("input_sha256").distinct(), "input_sha256", "left_anti")


def embed(chunks: DataFrame, encoder, dimension: int) -> DataFrame:
    """chunk inputs to vectors, each distinct input once; encoder(texts) -> list of vectors is loaded once per worker."""
    distinct = chunks.select("input_sha256", "embedding_input").dropDuplicates(["input_sha256"])

    def run(batches):
        for frame in batches:
            yield pd.DataFrame({"input_sha256": frame.input_sha256, "embedding": list(encoder(frame.embedding_input.tolist()))})

    vectors = bound_batches(distinct).mapInPandas(run, "input_sha256 string, embedding array<float>")
    return chunks.join(validate_vectors(vectors, dimension), "input_sha256")


def write_index(chunks: DataFrame, state: DataFrame, path: str, version: str) -> int:
    """Commit chunks and their one-row state as a new version of the index, together: readers see the version before until then."""
    spark = chunks.sparkSession
    data = versions.write_data(chunks, path)
    return versions.commit(spark, path, {"data": data, "version": version, "state": state.first().asDict()})


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(chunks, state) of the newest version; None where there is none."""
    found = versions.manifest(spark, path)
    if found is None:
        return None
    return spark.read.parquet(f"{path}/{found['data']}"), spark.createDataFrame([{**found["state"], "version": found["version"]}])


def assert_fresh(state: DataFrame, identity: dict, fingerprint: str) -> None:
    row = state.first()
    if row is None or row["fingerprint"] != fingerprint or any(str(row[k]) != str(identity[k]) for k in IDENTITY):
        raise ValueError("the index is stale; build it again")


def hit_sources(hits: DataFrame, by: str) -> DataFrame:
    return hits.groupBy(by).agg(F.array_sort(F.collect_set("document_id")).alias("sources"))


def render_hits(hits: DataFrame, by: str) -> DataFrame:
    """Per run one text: a Source line of JSON and the verbatim chunk for each hit in rank order, blank lines between."""
    source = F.concat(F.lit("Source: "), F.to_json(F.struct("document_id", "chunk_id", "similarity")), F.lit("\n"), "text")
    return hits.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", source.alias("t")))), lambda x: x["t"]), "\n\n").alias("result"))


def recall_at_k(hits: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Per question the share of its relevant documents among those of its first k hits."""
    got = hits.filter(F.col("rank") <= k).groupBy("question_id").agg(F.collect_set("document_id").alias("got"))
    joined = questions.join(got, "question_id", "left")
    share = F.size(F.array_intersect("relevant_document_ids", F.coalesce("got", F.array().cast("array<string>")))) / F.size("relevant_document_ids")
    return joined.select("question_id", F.when(F.size("relevant_document_ids") > 0, share).alias("recall"))
