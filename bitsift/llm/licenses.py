"""License scans by an exact set-similarity join; DataFrame functions only.

A block is a run of lines that aren't blank, a template the text of a license
notice; both are sets of words.  A block meets a template if one line of it, or a
window of as many words as the template's text has, wherever the lines break, holds
at least ``containment`` of the template's words.  Tokens are ordered by their frequency over all documents
(counted for the words of templates; no other word takes part in an overlap), the
rarest first.  With T a template's size and need = ceil(containment * T):

* prefix filter: a block that meets it has one of its T - need + 1 rarest words;
* length filter: the block has at least ``need`` distinct words;
* positional filter: from the shared prefix word on, what is left in this order of the
  template's words and of the block's words that templates have reaches ``need`` in both;
* verification: the exact overlap, with the block, then with its lines and windows.

Texts without any prefix word are passed over before they're cut into blocks.
Templates are a parameter of fixed size, so their tables are broadcast; matches
are aggregated by document before they're joined back.

Besides, the base places of given phrases (words that stand consecutively) are
counted exactly.  score is 1 where a phrase stands, else the largest containment
of a block that meets its template, else 0.

Cases: a null or empty text has no words, places and labels, and score 0;
repeated templates or blocks change nothing; rows that repeat an id are scanned
one by one (equal texts of one id share their matches); a null id keeps its row;
an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitsift.llm.common import join_sized, materialise

# Phrases and labels of the contract.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening sentences of public license notices.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
CONTAINMENT = 0.9
#: What parts two blocks: a line that is empty or of white space.
PARTING = r"\n[\x20\x09\x0B-\x0D]*\n"


def words(text: Column) -> Column:
    """Lower-cased words: runs of digits, ASCII letters and code points over 127."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")


def word_run(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def template_words(text: str) -> list[str]:
    return sorted(set(word_run(text)))


def need_of(size: int, containment: float) -> int:
    return max(1, math.ceil(round(containment * size, 9)))


def frequencies(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the templates is; one row a word reaches the driver."""
    own = docs.select(F.explode(F.array_intersect(words(F.col(text_col)), F.array(*map(F.lit, vocabulary)))).alias("word"))
    return {r["word"]: r["n"] for r in own.groupBy("word").agg(F.count("*").alias("n")).collect()}


def candidates(docs: DataFrame, id_col: str, text_col: str, templates: list[tuple[str, str]], containment: float, positional: bool = True) -> DataFrame | None:
    """Blocks and templates that the filters leave: id, text_hash, block, lines, own, template, label, tokens, need, size, length."""
    spark = docs.sparkSession
    sets: dict[tuple, int] = {}
    for label, text in templates:
        if ws := tuple(template_words(text)):
            sets[label, ws] = max(sets.get((label, ws), 0), len(word_run(text)))
    if not sets:
        return None
    vocabulary = sorted({w for _, ws in sets for w in ws})
    counted = frequencies(docs, text_col, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    rows = []
    for number, ((label, ws), length) in enumerate(sorted(sets.items())):
        ordered, need = sorted(ws, key=rank.__getitem__), need_of(len(ws), containment)
        rows += [(w, rank[w], number, label, ordered, need, len(ws), length) for w in ordered[: len(ws) - need + 1]]
    index = F.broadcast(spark.createDataFrame(rows, "word string, rank int, template int, label string, tokens array<string>, need int, size int, length int"))
    prefix = F.array(*[F.lit(w) for w in sorted({r[0] for r in rows})])
    text = F.coalesce(F.col(text_col), F.lit(""))
    hit = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).where(F.arrays_overlap(words(F.col("text")), prefix))
    # a run of lines with words is one block; a line without any parts two
    blocks = hit.select("id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", PARTING, -1)).alias("block", "lines"))
    blocks = blocks.select("id", "text_hash", "block", "lines", F.array_distinct(words(F.col("lines"))).alias("own"))
    order = F.array(*[F.lit(w) for w in sorted(vocabulary, key=rank.__getitem__)])  # a word's rank is its place less one
    known = F.transform(F.array_intersect(order, "own"), lambda w: F.array_position(order, w) - 1)
    probes = blocks.withColumn("known", known).withColumn("word", F.explode(F.array_intersect("own", prefix)))
    paired = probes.join(index, "word").where(F.size("own") >= F.col("need"))
    # a template's prefix words all leave ``need`` of its own; of the block, the words from this rank on are left
    left = F.size(F.filter("known", lambda r: r >= F.col("rank")))
    return paired.where(left >= F.col("need")) if positional else paired


def matches(docs: DataFrame, id_col: str, text_col: str, templates: list[tuple[str, str]], containment: float) -> DataFrame:
    """(id, text_hash, block, label, containment) for every block that meets a template."""
    paired = candidates(docs, id_col, text_col, templates, containment)
    if paired is None:
        return docs.sparkSession.createDataFrame([], "id long, text_hash long, block int, label string, containment double")
    shared = F.size(F.array_intersect("own", "tokens"))
    able = paired.where(shared >= F.col("need"))
    # within the block the words must stand on one line, or in a window as long as the template's text
    overlap = lambda own: F.size(F.array_intersect(own, F.col("tokens")))
    by_line = F.array_max(F.transform(F.split("lines", "\n", -1), lambda line: overlap(words(line))))
    starts = lambda run: F.sequence(F.lit(0), F.greatest(F.size(run) - F.col("length"), F.lit(0)))
    windows = lambda run: F.array_max(F.transform(starts(run), lambda i: overlap(F.slice(run, i + 1, F.col("length")))))
    by_window = F.transform(F.array(words(F.col("lines"))), windows)[0]  # the words are cut once, as the lambda's argument
    met = able.withColumn("shared", F.greatest(by_line, by_window)).where(F.col("shared") >= F.col("need"))
    return met.groupBy("id", "text_hash", "block", "template").agg(F.first("label").alias("label"), F.max(F.col("shared") / F.col("size")).alias("containment")).drop("template")


def places(own: Column, phrase: str) -> Column:
    """Where (from 0) the phrase's words stand consecutively; texts that lack one of them aren't searched."""
    ws = phrase.split(" ")
    whole = F.array(*map(F.lit, ws))
    last = F.size(own) - len(ws)
    found = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(own, i + 1, len(ws)) == whole)
    return F.when((last >= 0) & F.array_contains(own, ws[0]) & F.array_contains(own, ws[-1]), found).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = matches(docs, id_col, text_col, templates, containment)
    added = materialise(found.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("label")).alias("added"), F.max("containment").alias("best")), "license-matches")
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = text.select("id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("own"))
    placed = split.select("id", "text_hash", F.size("own").cast("long").alias("n_words"), *[places(F.col("own"), p).alias(f"p{i}") for i, p in enumerate(phrases)])
    every = F.flatten(F.array(*[F.col(f"p{i}") for i in range(len(phrases))]))
    base = F.flatten(F.array(*[F.when(F.size(f"p{i}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for i, label in enumerate(phrases.values())]))
    based = placed.select("id", "text_hash", "n_words", every.alias("places"), F.array_sort(F.array_distinct(base)).alias("base"))
    renamed = added.withColumnsRenamed({"id": "id_", "text_hash": "hash_"}).withColumn("null_id", F.col("id_").isNull())
    keyed = based.withColumns({"hash_": F.col("text_hash"), "id_": F.coalesce("id", F.lit(0)), "null_id": F.col("id").isNull()})
    joined = join_sized(keyed, renamed.withColumn("id_", F.coalesce("id_", F.lit(0))), ["id_", "null_id", "hash_"], "left", 120)
    return joined.select(
        "id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("added", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle_sql(phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """The rows in DuckDB's SQL, by plain comparison of every line with every template: the same where no notice is wrapped."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrase_rows = ", ".join(f"({p.split(' ')!r}, {label!r})" for p, label in phrases.items())
    template_rows = ", ".join(f"({label!r}, {template_words(t)!r}, {need_of(len(template_words(t)), containment)})" for label, t in templates)
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all({low.format("coalesce(text, '')")}, {word}) AS own FROM documents),
phrases(ws, label) AS (VALUES {phrase_rows}),
templates(label, ws, need) AS (VALUES {template_rows}),
starts AS (SELECT doc_id, own, unnest(range(len(own))) AS i FROM w),
places AS (SELECT doc_id, i, label FROM starts, phrases WHERE own[i + 1] = ws[1] AND list_slice(own, i + 1, i + len(ws)) = ws),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, list_distinct(regexp_extract_all({low.format("unnest(string_split(text, chr(10)))")}, {word})) AS own FROM w),
met AS (SELECT doc_id, label, len(list_intersect(own, ws)) / len(ws) AS c FROM blocks, templates WHERE len(own) >= need AND len(list_intersect(own, ws)) >= need),
added AS (SELECT doc_id, max(c) AS best FROM met GROUP BY doc_id),
names AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM met UNION SELECT doc_id, label FROM places) GROUP BY doc_id)
SELECT doc_id, len(own)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.a::BIGINT AS first_word, base.b::BIGINT AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(names.labels, '') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN added USING (doc_id) LEFT JOIN names USING (doc_id)
"""
