"""Operator 7: licence scan, an exact set-similarity join in SQL functions only.

Base: places where the words of a fixed phrase stand one after another.

Method: a text is cut into overlapping blocks of ``2 * STEP`` words, a step of
``STEP`` apart, so every passage of up to ``STEP`` words lies whole in one of
them however its lines are wrapped.  A block is a set of words; a template (a
set of words too) is met where a block holds at least ``CONTAINMENT`` of its
words.  The words of the templates are put in the order of their frequency over
all blocks that could meet any of them, rarest first, and then

* prefix filter: a block with ``need`` of a template's ``n`` words holds one of
  its ``n - need + 1`` rarest, so only those words are joined on;
* length filter: the block holds at least ``need`` template words in all;
* positional filter: after the first common word enough words are left, in
  both, to reach ``need``.

What is left is verified by intersection.  The texts are read once: what is
kept of a document is its counts and, for each block, the numbers of the
template words in it.  The templates are constants, so the side that is
broadcast has a fixed size; only the few (row, template) pairs found are
shuffled.  No Python runs on the executors.

Defined results: null text counts as empty and has no words; without any place
or met template ``first_word``/``last_word`` are null, labels are empty and
``score`` is 0; a base place scores 1, else the largest containment found
counts; repeated rows each get a row; other columns are ignored.  Texts of any
length are read whole; a template of more than ``STEP`` words is an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodeframe.llm.shared import materialize

#: Phrase and label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label and notice.
TEMPLATES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit-notice", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright"),
)
CONTAINMENT = 0.8
#: words from one block to the next; a block has twice as many
STEP = 20

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# From where the last piece ended: a long tail without a space is tried once.
_PIECE = rf"\G((?:[^ ]++ ){{{STEP}}})"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``flat``: the words of a text with one space between them."""
    lowered = F.translate(F.coalesce(docs[text_col], F.lit("")), _UPPER, _LOWER)
    return docs.select(docs[id_col].alias("doc_id"), F.trim(F.regexp_replace(lowered, _SEPARATORS, " ")).alias("flat"))


def _base(flat: DataFrame) -> DataFrame:
    """Counts and places of the phrases, beside ``doc_id`` and ``blocks``."""
    n_words = F.when(F.col("flat") == "", 0).otherwise(_spaces(F.col("flat")) + 1).cast("bigint")
    has_any = F.lit(False)
    for phrase in PHRASES:
        has_any = has_any | F.contains("flat", F.lit(phrase))
    # Two spaces between words: neighbouring places then share no character.
    wide = F.when(has_any, F.concat(F.lit(" "), F.replace("flat", F.lit(" "), F.lit("  ")), F.lit(" ")))
    out = flat.select("doc_id", "blocks", n_words.alias("n_words"), wide.alias("wide"))
    parts = {}
    for phrase, label in PHRASES.items():
        pattern = " " + phrase.replace(" ", "  ") + " "
        parts[label] = F.when(F.contains("wide", F.lit(pattern)), F.split("wide", pattern, -1)).alias(f"_{label}")
    out = out.select("doc_id", "blocks", "n_words", *parts.values())
    n_base, firsts, lasts, labels = F.lit(0), [], [], []
    for phrase, label in PHRASES.items():
        p = F.col(f"`_{label}`")
        n_base = n_base + F.coalesce(F.size(p) - 1, F.lit(0))
        firsts.append((_spaces(F.element_at(p, 1)) / 2).cast("bigint"))
        lasts.append((F.col("n_words") - (_spaces(F.element_at(p, -1)) / 2).cast("bigint") - len(phrase.split())).cast("bigint"))
        labels.append(F.when(p.isNotNull(), F.lit(label)))
    return out.select(
        "doc_id", "blocks", "n_words", n_base.cast("bigint").alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), F.array_sort(F.array_compact(F.array(*labels))).alias("base")
    )


def _with_blocks(texts: DataFrame, vocabulary: list[str], least: int) -> DataFrame:
    """Adds ``blocks``: for each block with ``least`` template words or more, their numbers in ``vocabulary``."""
    known = F.array(*map(F.lit, vocabulary))
    pieces = texts.withColumn("pieces", F.split(F.regexp_replace("flat", _PIECE, "$1\n"), "\n"))
    held = pieces.withColumn("held", F.zip_with("pieces", F.slice("pieces", 2, F.size("pieces")), lambda a, b: F.array_intersect(F.split(F.concat_ws(" ", a, b), " "), known)))
    numbers = F.transform(F.filter("held", lambda b: F.size(b) >= least), lambda b: F.transform(b, lambda w: F.array_position(known, w).cast("int")))
    return held.select("doc_id", "flat", numbers.alias("blocks"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    if any(len(text.split()) > STEP for _, text in templates):
        raise ValueError(f"a template has at most {STEP} words")
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    needs = {label: math.ceil(containment * len(words) - 1e-9) for label, words in sets}
    vocabulary = sorted({w for _, words in sets for w in words})
    base = materialize(_base(_with_blocks(_texts(docs, id_col, text_col), vocabulary, min(needs.values()))).withColumn("row", F.monotonically_increasing_id()), "licences")
    blocks = base.select("row", F.explode("blocks").alias("block"))
    # One count for each word of the constant templates.
    counted = dict(blocks.select(F.explode("block").alias("word")).groupBy("word").count().collect())
    order = sorted(range(1, len(vocabulary) + 1), key=lambda w: (counted.get(w, 0), w))
    rank = {vocabulary[w - 1]: i + 1 for i, w in enumerate(order)}
    rows = []
    for label, words in sets:
        need, ranks = needs[label], sorted(rank[w] for w in words)
        rows += [(r, label, i + 1, need, ranks) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    prefixes = spark.createDataFrame(rows, "rank int, label string, t_place int, need int, ranks array<int>")
    joined_on = F.array(*(F.lit(r) for r in sorted({row[0] for row in rows})))
    rank_of = F.array(*(F.lit(rank[w]) for w in vocabulary))
    ranked = F.array_sort(F.transform("block", lambda w: F.element_at(rank_of, w)))
    met = (
        blocks.select("row", ranked.alias("held"))
        .where(F.arrays_overlap("held", joined_on))
        .select("row", "held", F.posexplode("held").alias("b_place", "rank"))
        .join(F.broadcast(prefixes), "rank")
        .where((F.size("held") >= F.col("need")) & (1 + F.least(F.size("ranks") - F.col("t_place"), F.size("held") - F.col("b_place") - 1) >= F.col("need")))
        .withColumn("common", F.size(F.array_intersect("held", "ranks")))
        .where(F.col("common") >= F.col("need"))
        .groupBy("row")
        .agg(F.collect_set("label").alias("met"), F.max(F.col("common") / F.size("ranks")).alias("share"))
    )
    none = F.array().cast("array<string>")
    out = base.drop("blocks").join(met, "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("met", none))))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def oracle(documents: str = "documents", templates=TEMPLATES, containment: float = CONTAINMENT) -> str:
    """The same result in DuckDB SQL, every block against every template."""
    phrases = ", ".join(f"('{p}', '{x}', {len(p.split())})" for p, x in PHRASES.items())
    notices = ", ".join(f"('{x}', list_distinct(string_split('{t}', ' ')))" for x, t in templates)
    return rf"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM {documents}),
words AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{_SEPARATORS}'), lambda w: w <> '') AS w FROM low),
phrases(phrase, label, n) AS (VALUES {phrases}),
places AS (
  SELECT r, label, i - 1 AS place FROM words, phrases, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
  WHERE contains(t, split_part(phrase, ' ', 1)) AND array_to_string(w[i:i + n - 1], ' ') = phrase),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS base FROM places GROUP BY r),
templates(label, words) AS (VALUES {notices}),
blocks AS (SELECT r, list_distinct(w[k + 1:k + {2 * STEP}]) AS held FROM (SELECT r, w, unnest(range(0, len(w), {STEP})) AS k FROM words)),
met AS (
  SELECT r, list(DISTINCT label) AS met, max(share) AS share
  FROM (SELECT r, label, len(list_intersect(held, words)) / len(words) AS share FROM blocks, templates)
  WHERE share >= {containment} - 1e-9 GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []::VARCHAR[]), coalesce(met, []::VARCHAR[])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM words LEFT JOIN base USING (r) LEFT JOIN met USING (r)
"""
