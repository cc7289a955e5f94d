"""The Merkle manifest against a plain tree, and the sharing of nodes between versions."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sparkguard.llm import merkle

ROWS = "doc_id long, text string, lang string, source string, n_chars long, digest string, position string, changed int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of every row, level by level over lists."""

    def build(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            out.append((run[: i % 8], run[i % 8 + 1 :]))
            i //= 8
        return out

    def leaf(row, text):
        return h(*map(value, (row[0], row[3], row[2], row[4], text)))

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for x in langs}
    trees = {x: build([leaf(r, r[1]) for r in of[x]]) for x in langs}
    top = build([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(of[x]):
            way = path(trees[x], i) + path(top, k)
            hit = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])) if hit else leaf(r, r[1])
            for left, right in way:
                node = h(*left, node, *right)
            root = top[-1][0]
            out.append((r[0], trees[x][0][i], trees[x][-1][0], root, h(*(c for left, right in way for c in left + right)), node, node == root))
    return out


def rows(sizes, start=0):
    out = []
    for lang, n in sizes.items():
        for i in range(n):
            d = start + len(out)
            out.append((d, [f"Text {d} É", None, "", "plain", "X" * 500][d % 5], lang, None if d % 7 == 0 else f"s{d % 3}", None if d % 11 == 0 else d, "x", "y", 1))
    return out


def check(spark, data, levels=merkle.LEVELS):
    got = [tuple(r) for r in merkle.digest(spark.createDataFrame(data, ROWS).repartition(3), levels).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(data)))


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_equals_a_plain_tree(spark, levels):
    odd = [(None, "A", "en", None, None, "", "", 0), (None, "B", "en", None, None, "", "", 0), (3, "Same", "en", "s", 1, "", "", 0), (3, "Same", "en", "s", 1, "", "", 0), (3, "Other", "en", "s", 1, "", "", 0), (9, "L" * 200_000, "ü", "s", 2, "", "", 0)]
    check(spark, rows({"en": 130, "de": 9, None: 8, "": 1, "fr": 64}, 10) + odd, levels)


def test_many_partitions(spark):
    check(spark, rows({f"l{i}": 1 + i % 3 for i in range(70)}))


def test_lone_leaf_and_empty_table(spark):
    check(spark, rows({"en": 1}))
    assert merkle.digest(spark.createDataFrame([], ROWS)).count() == 0


def test_versions_share_untouched_nodes():
    leaves = [h(str(i)).encode() for i in range(500)]
    tree = merkle.PersistentTree.build(leaves, 3)
    size, root = len(tree.digests), tree.digests[tree.root]
    for i in (0, 77, 499):
        before = len(tree.digests)
        new = tree.version(i, b"0" * 64, 3)
        assert len(tree.digests) - before == 4  # the leaf and its three ancestors
        changed = [a for a, b in zip(tree.children[tree.root], tree.children[new], strict=True) if a != b]
        assert len(changed) == 1 and tree.digests[new] == merkle.fold(b"0" * 64, tree.path(i, 3))
    assert tree.digests[tree.root] == root and all(tree.children[tree.root][k] < size for k in range(8))


def test_proofs_and_changed_texts(spark):
    docs = spark.createDataFrame(rows({"en": 600, "de": 3}), ROWS)
    found = merkle.manifest(docs, F.when(F.col("doc_id") == 5, F.lit("forged")))
    bad = found.withColumn("again", merkle.refold(F.col("leaf"), "siblings")).select("doc_id", (F.col("again") == F.col("root")).alias("proof"), (F.col("version_root") == F.col("root")).alias("same")).collect()
    assert all(r.proof for r in bad) and [r.doc_id for r in bad if not r.same] == [5]
