"""Ranked lexical search of a query set against all documents: a dual-tree search for maximum inner products, exact.

An item is a vector of zeros and ones over the vocabulary of its block of items; a document's coordinate of a term is the whole-number part
that the term adds to its score, so that scores are inner products. The items form a balanced binary tree whose nodes hold coordinate maxima,
which are the unions of their items' terms; the items are halved by what they have in common with two unlike items. Each task makes
hierarchies of its documents, `LEVELS` below blocks of at most CELLS coordinates, ordered by the part of the item tree that they are closest to;
their nodes hold coordinate maxima too. The search descends both trees together: the inner product of two nodes' maxima bounds the score of
every pair below them, and where it is less than the weakest kth score of the node's items, all pairs are pruned at once. Weakest scores start
from the exact kth scores among the documents of a hash sample, which every later answer reaches, and rise as the task finds more. Tasks return
at most k documents an item, which are ranked by a window.

Terms are equal if their 64-bit hashes are. Counts and statistics cover all documents. Items are taken in blocks by a hash, so that a block's
vocabulary has about MAX_TERMS at most and can be broadcast; each block reads the documents once.

Null, empty and wordless texts have no term; such documents count for nothing and are never found, such items find nothing. Rows that share an
item_id, null too, are one item with the terms of all. Rows that share a doc_id are documents of their own, each ranked; null doc_ids come first among
equal scores. Very long texts are read whole. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, byte_set, first_rows, materialize, slices, utf8, word_hashes, word_spans

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
TOP = 50
#: Item terms of a block of items, about.
MAX_TERMS = 1 << 20
#: Coordinates of a block of documents (8 bytes each) and its documents at most.
CELLS, BLOCK = 1 << 22, 1024
#: Documents of a node, by level; the last level's nodes are documents.
LEVELS = (BLOCK, 128, 16, 1)
#: One document in so many sets the first weakest scores.
SEED = 32


def terms_of(text: str = "text") -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(TERM), F.lit(0))


@dataclass
class ItemNode:
    """Items [lo, hi) of the ordered items, the union of their terms, and the halves."""

    lo: int
    hi: int
    terms: np.ndarray
    halves: tuple[ItemNode, ...] = ()


@dataclass
class ItemTree:
    """ids and terms (ascending places in the vocabulary) of the items in the tree's order, and its root."""

    ids: list
    terms: list[np.ndarray]
    root: ItemNode

    @classmethod
    def build(cls, ids: list, terms: list[np.ndarray], weight: np.ndarray) -> ItemTree:
        """Halve the items by what they share with the heaviest item and with the one that shares least with it."""
        order: list[int] = []

        def shared(a: int, items: list[int]) -> np.ndarray:
            mark = np.zeros(len(weight))
            mark[terms[a]] = weight[terms[a]]
            return np.array([mark[terms[i]].sum() for i in items])

        def node(items: list[int]) -> ItemNode:
            lo = len(order)
            if len(items) == 1:
                order.append(items[0])
                return ItemNode(lo, lo + 1, terms[items[0]])
            a = max(items, key=lambda i: weight[terms[i]].sum())
            with_a = shared(a, items)
            closer = with_a - shared(items[int(with_a.argmin())], items)
            by = [items[i] for i in np.argsort(-closer, kind="stable")]
            halves = (node(by[: len(by) // 2]), node(by[len(by) // 2 :]))
            return ItemNode(lo, len(order), np.union1d(halves[0].terms, halves[1].terms), halves)

        root = node(list(range(len(ids))))
        return cls([ids[i] for i in order], [terms[i] for i in order], root)

    def nodes(self, least: int) -> list[ItemNode]:
        """The first nodes from the root down that hold at most least items."""
        out, todo = [], [self.root]
        while todo:
            n = todo.pop()
            if n.hi - n.lo <= least or not n.halves:
                out.append(n)
            else:
                todo.extend(n.halves)
        return out


@dataclass
class DocumentTree:
    """Documents of a block in the tree's order: coordinates[level][term, node] are maxima, those of the last level exact."""

    places: np.ndarray
    coordinates: list[np.ndarray]

    @classmethod
    def build(cls, row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, groups: list[np.ndarray]) -> DocumentTree:
        """row, term (dense) and value of the coordinates that aren't zero; groups: terms of the item nodes that order the documents."""
        of_terms = int(term.max()) + 1 if len(term) else 0
        close = np.zeros((len(groups), n))
        for g, members in enumerate(groups):
            mark = np.zeros(of_terms, bool)
            mark[members] = True
            close[g] = np.bincount(row, np.where(mark[term], value, 0), minlength=n)
        near = close.argmax(0) if len(groups) else np.zeros(n, np.int64)
        order = np.lexsort((-close.max(0) if len(groups) else near, near))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        full = -(-n // LEVELS[-2]) * LEVELS[-2]
        exact = np.zeros((of_terms, full), np.int64)
        exact[term, rank[row]] = value
        out = [exact]
        for above, below in zip(LEVELS[-2::-1], LEVELS[:0:-1], strict=True):
            width = above // below
            last = out[-1]
            pad = -last.shape[1] % width
            out.append(np.pad(last, ((0, 0), (0, pad))).reshape(of_terms, -1, width).max(2))
        return cls(order, out[::-1])


@dataclass
class Search:
    """The best k documents of each item so far; weakest: the score below which a document can't be one of an item's k best."""

    tree: ItemTree
    k: int
    weakest: np.ndarray
    scores: list[np.ndarray] = field(default_factory=list)
    ids: list[np.ndarray] = field(default_factory=list)
    scored: int = 0
    pairs: int = 0

    def __post_init__(self):
        self.scores = [np.zeros(0, np.int64) for _ in self.tree.ids]
        self.ids = [np.zeros(0, np.int64) for _ in self.tree.ids]

    def add(self, docs: DocumentTree, dense: np.ndarray, ids: np.ndarray) -> None:
        """Search a block; dense: where each of the vocabulary's terms stands in its coordinates, -1 if nowhere."""
        self.pairs += len(docs.places) * len(self.tree.ids)
        ids = ids[docs.places]
        everything = np.arange(docs.coordinates[0].shape[1])
        todo = [(self.tree.root, 0, everything)]
        while todo:
            node, level, some = todo.pop()
            at = dense[node.terms]
            at = at[at >= 0]
            matrix = docs.coordinates[level]
            if level == len(LEVELS) - 1:
                some = some[some < len(ids)]
                self.scored += len(some)
                self._keep(node.lo, matrix[np.ix_(at, some)].sum(0), ids[some])
                continue
            bounds = (matrix[at] if len(some) == matrix.shape[1] else matrix[np.ix_(at, some)]).sum(0)
            some = some[bounds >= max(1, int(self.weakest[node.lo : node.hi].min()))]
            if not len(some):
                continue
            if level < len(LEVELS) - 2 or not node.halves:
                width = LEVELS[level] // LEVELS[level + 1]
                some = (some[:, None] * width + np.arange(width)).ravel()
                some = some[some < docs.coordinates[level + 1].shape[1]]
                level += 1
            todo.extend((half, level, some) for half in node.halves or (node,))

    def _keep(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= max(1, self.weakest[item])
        if not good.any():
            return
        scores, ids = np.concatenate((self.scores[item], scores[good])), np.concatenate((self.ids[item], ids[good]))
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[best], ids[best]
        if len(best) == self.k:
            self.weakest[item] = max(self.weakest[item], self.scores[item][-1])


def vocabulary(terms: list[str]) -> np.ndarray:
    """Hashes of terms, in their order."""
    data, offsets = utf8(pa.array(terms, pa.string()))
    return word_hashes(data, offsets[:-1], offsets[1:])


def postings(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """doc_id, n (all terms), and term (place in the vocabulary) and tf of each of the vocabulary's terms in a document that has terms."""
    order = np.argsort(words)
    shared = docs.sparkSession.sparkContext.broadcast((words[order], order))

    def work(batches):
        known, place = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                part = data[offsets[i] : offsets[j]]
                starts, ends, row = word_spans(part, offsets[i : j + 1] - offsets[i], SEPARATORS)
                n = np.bincount(row, minlength=j - i)
                hashes = word_hashes(part, starts, ends, lower=True)
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                pair, tf = np.unique(row[hit] * max(len(known), 1) + place[at[hit]], return_counts=True)
                of, term = np.divmod(pair, max(len(known), 1))
                cuts = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=j - i)))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (term, tf)]
                found = pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), *lists], ["doc_id", "n", "term", "tf"])
                yield found.filter(pa.array(n > 0))

    return bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n long, term array<int>, tf array<int>")


def document_frequencies(table: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of the vocabulary's size terms; each task counts what it reads."""

    def work(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    out = np.zeros(size, np.int64)
    for term, n in table.select("term").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row a term of the items
        out[term] = n
    return out


def parts(weight: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What each term adds to its document's score; n is its document's number of terms."""
    m = 100 - 50 + (50 * n * documents) // length
    return weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def search_batch(search: Search, weight: np.ndarray, groups: list[ItemNode], ids: np.ndarray, n: np.ndarray, counts: np.ndarray, term: np.ndarray, tf: np.ndarray, documents: int, length: int) -> None:
    """Search documents whose counts coordinates each follow one another, in blocks of at most BLOCK documents and CELLS coordinates."""
    first = np.concatenate((first_rows(counts), [len(term)])) if len(counts) else np.zeros(1, np.int64)
    todo = [(lo, min(lo + BLOCK, len(ids))) for lo in range(0, len(ids), BLOCK)][::-1]
    while todo:
        lo, hi = todo.pop()
        some = term[first[lo] : first[hi]]
        seen = np.unique(some)
        if len(seen) * (hi - lo) > CELLS and hi - lo > 1:
            todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
            continue
        if not len(seen):
            search.pairs += (hi - lo) * len(search.tree.ids)
            continue
        dense = np.full(len(weight), -1, np.int64)
        dense[seen] = np.arange(len(seen))
        row = np.repeat(np.arange(hi - lo), counts[lo:hi])
        value = parts(weight, some, tf[first[lo] : first[hi]], n[lo:hi][row], documents, length)
        members = [dense[g.terms] for g in groups]
        search.add(DocumentTree.build(row, dense[some], value, hi - lo, [m[m >= 0] for m in members]), dense, ids[lo:hi])


#: Stands for a null doc_id inside tasks, below all others.
_NULL = np.iinfo(np.int64).min


def _found(table: DataFrame, tree: ItemTree, weight: np.ndarray, weakest: np.ndarray, documents: int, length: int, k: int, report: bool = False) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of each item; report: the pairs that it has and has scored."""
    shared = table.sparkSession.sparkContext.broadcast((tree, weight, weakest))

    def work(batches):
        tree, weight, weakest = shared.value
        search, groups = Search(tree, k, weakest.copy()), tree.nodes(max(1, len(tree.ids) // 16))
        for batch in batches:
            ids, n, terms, tf = batch.columns
            counts = np.diff(np.asarray(terms.offsets).astype(np.int64))
            doc_ids = np.asarray(ids.fill_null(_NULL))
            search_batch(search, weight, groups, doc_ids, np.asarray(n), counts, np.asarray(terms.flatten()).astype(np.int64), np.asarray(tf.flatten()).astype(np.int64), documents, length)
        if report:
            yield pa.RecordBatch.from_arrays([pa.array([search.pairs]), pa.array([search.scored])], ["pairs", "scored"])
            return
        item = np.repeat(np.arange(len(tree.ids)), [len(x) for x in search.ids])
        ids, scores = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (search.ids, search.scores))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == _NULL), pa.array(scores)], ["item", "doc_id", "score"])

    return table.mapInArrow(work, "pairs long, scored long" if report else "item long, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@dataclass
class Prepared:
    """A block of items over the written postings of all documents."""

    table: DataFrame
    tree: ItemTree
    weight: np.ndarray
    documents: int
    length: int
    weakest: np.ndarray


def prepare(docs: DataFrame, items: list, k: int = TOP) -> Prepared | None:
    """items: (item_id, terms) rows of a block; None if no document or no item has a term."""
    words = sorted({t for _, terms in items for t in terms})
    place = {w: i for i, w in enumerate(words)}
    table = materialize(postings(docs, vocabulary(words)), "postings")
    documents, length = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not documents or not items:
        return None
    df = document_frequencies(table, len(words))
    weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    tree = ItemTree.build([i for i, _ in items], [np.array(sorted({place[t] for t in terms}), np.int64) for _, terms in items], weight)
    seeds = _found(table.filter(f"pmod(xxhash64(doc_id, n), {SEED}) = 0"), tree, weight, np.zeros(len(items), np.int64), documents, length, k)
    weakest = np.zeros(len(items), np.int64)
    for item, score in ranked(seeds, k).filter(F.col("rank") == k).select("item", "score").collect():  # one row an item of the block
        weakest[item] = score
    return Prepared(table, tree, weight, documents, length, weakest)


def item_blocks(items: DataFrame) -> list[list]:
    """(item_id, terms) of the items that have terms, in blocks of about MAX_TERMS terms."""
    terms = materialize(items.select("item_id", F.explode(F.array_distinct(terms_of())).alias("term")).distinct(), "item-terms")
    n = -(-terms.count() // MAX_TERMS)
    for b in range(n):
        own = terms.filter(f"pmod(xxhash64(item_id), {n}) = {b}").groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
        yield [(r.item_id, r.terms) for r in own.collect()]  # bounded by the block


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0, equal scores by doc_id."""
    kind = items.schema["item_id"].dataType
    out = docs.sparkSession.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for block in item_blocks(items):
        if p := prepare(docs, block, k):
            best = ranked(_found(p.table, p.tree, p.weight, p.weakest, p.documents, p.length, k), k)
            names = docs.sparkSession.createDataFrame(list(enumerate(p.tree.ids)), f"item long, item_id {kind.simpleString()}")
            out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # a block's ids
    return out


def pruning(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """pairs and scored: the pairs of documents and items, and those whose score was computed."""
    out = docs.sparkSession.createDataFrame([], "pairs long, scored long")
    for block in item_blocks(items):
        if p := prepare(docs, block, k):
            out = out.unionByName(_found(p.table, p.tree, p.weight, p.weakest, p.documents, p.length, k, report=True))
    return out.agg(F.sum("pairs").alias("pairs"), F.sum("scored").alias("scored"))


_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS length FROM d),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
iw AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
df AS (SELECT t, count(*) AS df FROM tf WHERE t IN (SELECT t FROM iw) GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, s),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(w) * docs) // length AS m FROM d, s WHERE len(w) > 0),
p AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS part FROM tf JOIN w USING (t) JOIN m USING (r)),
scores AS (SELECT item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM iw JOIN p USING (t) GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {TOP}"""
