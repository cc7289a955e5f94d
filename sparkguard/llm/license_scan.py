"""Licence scanning with a positional rare-token index, in DataFrame functions only.

Templates are notices of licences with the key phrases that each of its copies must hold at their places (their other words may
differ), and names of licences, whose one key phrase is the whole template. Over the whole corpus the document frequency of every key
word is counted; each template is indexed by its RARE words of highest IDF, each posting holding the word's position in
the template. A file's words are looked up in that index; a hit's relative position (place in the file - place in the
template) is where the template would start, and the postings of one template intersect where all its indexed words
agree on that start. There the mandatory key phrases are verified word by word. As a copy that holds its key phrases
brings its rare words to one start, no place is missed, whatever their frequency; so the words are chosen by template and
not by file, where a limit on a file's words would lose places.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased; positions count words from 0. Null text
counts as empty: no words, null first and last word, empty labels, score 0. Very long texts are scanned whole. Rows are
independent; repeated rows repeat and null doc_ids are carried. Ties in frequency go to the earlier word. An empty table gives no
rows. Other columns, whatever their names, are not read. Score is the share of a file's words that stand in key phrases, at most 1.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: label: key phrases. The first three are the base; the others are the method's own.
BASE = {"mit": ["mit license"], "apache": ["apache license"], "gpl": ["general public license"]}
MORE = {
    "agpl": ["affero general public license"],
    "bsd": ["redistribution and use in source and binary forms"],
    "cc": ["creative commons attribution"],
    "epl": ["eclipse public license"],
    "isc": ["permission to use copy modify and or distribute this software"],
    "lgpl": ["lesser general public license"],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy"],
    "mpl": ["mozilla public license"],
    "unlicense": ["free and unencumbered software released into the public domain"],
}
#: label: words of a notice, key phrases in [ ].
NOTICES = {
    "mit": "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software [to deal in the software without restriction]",
    "apache": "[licensed under the apache license] version 2 0 the license you may not use this file [except in compliance with the license]",
    "gpl": "[this program is free software] you can redistribute it and or modify it [under the terms of the gnu general public license]",
    "lgpl": "[this library is free software] you can redistribute it and or modify it [under the terms of the gnu lesser general public license]",
    "agpl": "[this program is free software] you can redistribute it and or modify it [under the terms of the gnu affero general public license]",
    "bsd": "[redistribution and use in source and binary forms] with or without modification are permitted [provided that the following conditions are met]",
    "isc": "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted [provided that the above copyright notice and this permission notice appear in all copies]",
    "mpl": "[this source code form is subject to the terms of the mozilla public license] v 2 0 if a copy of the mpl was not distributed [with this file you can obtain one at]",
    "unlicense": "[this is free and unencumbered software released into the public domain] anyone is free to copy modify publish [use compile sell or distribute this software]",
    "zlib": "[this software is provided as is without any express or implied warranty] in no event will the authors be held liable [for any damages arising from the use of this software]",
}
RARE = 2
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

Phrase = tuple[int, list[str]]


def templates() -> list[tuple[int, bool, str, list[Phrase]]]:
    """(id, is base, label, key phrases with the place of their first word in the template)."""
    rows: list[tuple[bool, str, list[Phrase]]] = [(base, k, [(0, p.split())]) for base, table in ((True, BASE), (False, MORE)) for k, ps in table.items() for p in ps]
    for label, notice in NOTICES.items():
        phrases, at = [], 0
        for part in re.split(r"[\[\]]", notice):
            words = part.split()
            if f"[{part}]" in notice and words:
                phrases.append((at, words))
            at += len(words)
        rows.append((False, label, phrases))
    return [(i, *row) for i, row in enumerate(rows)]


def words_of(text: str = "text") -> Column:
    """Words in their given case; only A-Z differ from the lower-cased ones."""
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))


def word_frequencies(words: DataFrame) -> dict[str, int]:
    """Number of files with each template word (as written in a text: lower, Title or UPPER case); bounded by the vocabulary."""
    vocabulary = sorted({w for *_, phrases in templates() for _, p in phrases for w in p})
    forms = F.array(*[F.lit(f) for w in vocabulary for f in dict.fromkeys((w, w.capitalize(), w.upper()))])
    present = words.select(F.explode(F.array_distinct(F.transform(F.array_intersect("words", forms), F.lower))).alias("word"))
    counted = {r.word: r.n for r in present.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: counted.get(w, 0) for w in vocabulary}


def rare_index(frequency: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """word: postings (template, position) of each template's RARE rarest words; ties go to the earlier word."""
    index: dict[str, list[tuple[int, int]]] = {}
    for i, *_, phrases in templates():
        place: dict[str, int] = {}
        for at, words in phrases:
            for k, w in enumerate(words):
                place.setdefault(w, at + k)
        for w in sorted(place, key=lambda w: frequency[w])[:RARE]:
            index.setdefault(w, []).append((i, place[w]))
    return index


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row."""
    rows = docs.select("doc_id", "text", words_of().alias("words"))
    frequency = word_frequencies(rows)
    index, known = rare_index(frequency), templates()
    # a file without any template's rarest word has no place to look up
    rarest = sorted({min((w for _, p in phrases for w in p), key=lambda w: frequency[w]) for *_, phrases in known})
    possible = F.coalesce(F.col("text").rlike(f"(?i){'|'.join(rarest)}"), F.lit(False))
    lower = lambda w: F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # hits: places of indexed words; an element that can't be one of them by its length is dropped before lower-casing
    sizes = sorted({len(w) for w in index})
    hit = lambda w, i: F.when(F.length(w).isin(sizes) & lower(w).isin(sorted(index)), F.struct(lower(w).alias("w"), i.alias("at")))
    hits = F.filter(F.transform("words", hit), lambda x: x.isNotNull())
    postings = F.create_map(*[c for w, ps in sorted(index.items()) for c in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in ps]))])
    starts = F.flatten(F.transform("hits", lambda h: F.transform(postings[h.w], lambda p: F.struct(p.t.alias("t"), (h.at - p.p).alias("start")))))
    # a start that all indexed words of its template agree on stands as often in the sorted starts
    need = F.create_map(*[c for i, *_, phrases in known for c in (F.lit(i), F.lit(min(RARE, len({w for _, p in phrases for w in p}))))])
    agreed = F.filter(F.transform("starts", lambda x, i: F.when((x.start >= 0) & (F.get("starts", i + need[x.t] - 1) == x) & ((i == 0) | (F.get("starts", i - 1) != x)), x)), lambda x: x.isNotNull())
    phrase = F.create_map(*[c for i, *_, phrases in known for c in (F.lit(i), F.array(*[F.struct(F.lit(at).alias("at"), F.array(*map(F.lit, p)).alias("p")) for at, p in phrases]))])
    stands = lambda start, p: F.transform(F.slice("words", start + p.at + 1, F.size(p.p)), lower) == p.p
    verified = F.filter("agreed", lambda x: F.forall(phrase[x.t], lambda p: stands(x.start, p)))
    base = [i for i, b, *_ in known if b]
    label = F.create_map(*[c for i, _, k, _ in known for c in (F.lit(i), F.lit(k))])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: label[x.t]))), ",")
    found = (
        rows.withColumn("hits", F.when(possible, hits).otherwise(F.array().cast("array<struct<w:string,at:int>>")))
        .withColumn("starts", F.array_sort(starts))
        .withColumn("agreed", agreed)
        .select("doc_id", F.size("words").cast("long").alias("n_words"), verified.alias("places"))
        .withColumn("base", F.filter("places", lambda x: x.t.isin(base)))
    )
    size = F.create_map(*[c for i, *_, phrases in known for c in (F.lit(i), F.lit(sum(len(p) for _, p in phrases)))])
    covered = F.aggregate("places", F.lit(0), lambda acc, x: acc + size[x.t])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x.start)).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x.start)).cast("long").alias("last_word"),
        names("base").alias("base_labels"),
        names("places").alias("labels"),
        F.when(F.col("n_words") > 0, F.least(F.lit(1.0), covered / F.col("n_words"))).otherwise(0.0).alias("score"),
    )


def oracle_sql() -> str:
    """The same in SQL: every place of every phrase, by comparing slices of the words."""
    known = templates()
    stands = lambda phrases: " AND ".join(f"words[i + {at}:i + {at + len(p) - 1}] = {p!r}" for at, p in phrases)
    places = " UNION ALL ".join(
        f"SELECT k, {i} AS t, {'true' if b else 'false'} AS base, '{label}' AS label, {sum(len(p) for _, p in phrases)} AS size, i - 1 AS start FROM hit WHERE {stands(phrases)}" for i, b, label, phrases in known
    )
    first = sorted({phrases[0][1][0] for *_, phrases in known})
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
hit AS (SELECT k, words, i FROM (SELECT k, words, unnest(range(1, len(words) + 1)) AS i FROM d) WHERE words[i] IN ({", ".join(repr(w) for w in first)})),
places AS ({places}),
found AS (SELECT k, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, sum(size) AS covered FROM places GROUP BY k)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN len(words) > 0 THEN least(1.0, CAST(coalesce(covered, 0) AS DOUBLE) / len(words)) ELSE 0.0 END AS score
FROM d LEFT JOIN found USING (k)"""
