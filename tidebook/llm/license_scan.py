"""License scans by an exact set-similarity join of text blocks with templates.

A text is cut into blocks of BLOCK words that start every BLOCK/2 words, so that any
passage of up to BLOCK/2 words lies within one block. Longer templates meet blocks of twice
their size, which double from class to class. A block matches a template if it
contains at least `threshold` of the template's distinct words. Words of templates
are ordered by the number of documents that hold them, rarest first, counted over
all documents. For a template of size s that needs o common words:

- prefix filter: a match shares a word among the first s - o + 1 of the template and
  the first r - o + 1 of the block (r template words in it);
- length filter: r >= o;
- positional filter: words common before the shared one, the shared one and those
  that can follow on either side must reach o.

What passes is verified by intersection, so the join is exact; the order only decides
how much is left to verify. Besides, three fixed phrases are found where their words
stand consecutively.

Scale: no shuffle of texts. The order is one aggregation over (word, count) of
template words. Templates are the bounded side: they travel as literals, at most
CHUNK at a time. A text whose words miss all prefixes is done after one hash lookup a word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import let, read_table

THRESHOLD, BLOCK, CHUNK = 0.9, 48, 200
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that count wherever their words stand in a row, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: License statements and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2.0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license", "mpl-2.0"),
    ("made available under the terms of the eclipse public license", "epl"),
    ("licensed under cc by sa 4.0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4.0", "cc-by-nc-4.0"),
    ("licensed under cc by nd 4.0", "cc-by-nd-4.0"),
    ("licensed under a creative commons attribution license", "cc-by"),
    ("dedicated to the public domain under cc0", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

Template = tuple[str, str]


def scan_words(text: Column) -> Column:
    """Words of a text (null: none), A-Z lower-cased.

    lower() also folds other letters. Words are runs of non-separators either way, and
    no letter outside A-Z folds to one that the phrases hold, so counts, places and
    phrases are those of folding A-Z alone.
    """
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), lambda w: w != "")


def template_words(template: str) -> list[str]:
    """Distinct words of a template, in order of first use."""
    return list(dict.fromkeys(template.lower().replace(".", " ").replace("-", " ").split()))


def block_of(template: str, block: int = BLOCK) -> int:
    """Words of a block for a template: `block`, doubled until half of it holds the template."""
    while len(template.split()) > block // 2:
        block *= 2
    return block


def need(size: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * size, 9)))


def word_order(docs: DataFrame, templates: tuple[Template, ...]) -> list[str]:
    """All words of the templates, by number of documents that hold them, then by word."""
    vocabulary = sorted({w for t, _ in templates for w in template_words(t)})
    held = docs.select(F.explode(F.array_intersect(scan_words(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("w"))
    # one row per template word: bounded by the templates
    counts = {r.w: r.n for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def matches(words: Column, templates: tuple[Template, ...], order: list[str], threshold: float = THRESHOLD, block: int = BLOCK) -> Column:
    """Array of structs (label, containment) of the templates that some block of the words meets."""
    place = {w: k for k, w in enumerate(order)}
    own = [sorted(template_words(t), key=place.__getitem__) for t, _ in templates]
    index: dict[str, list[Column]] = {}
    for k, tokens in enumerate(own):
        o = need(len(tokens), threshold)
        for p, token in enumerate(tokens[: len(tokens) - o + 1]):
            entry = F.struct(F.lit(k).alias("t"), F.lit(p).alias("p"), F.lit(len(tokens)).alias("size"), F.lit(o).alias("need"))
            index.setdefault(token, []).append(entry)
    lookup = F.create_map(*[x for token, found in index.items() for x in (F.lit(token), F.array(*found))])
    tokens_of = F.array(*[_strings(tokens) for tokens in own])
    labels = _strings([label for _, label in templates])
    known = _strings([w for w in order if any(w in tokens for tokens in own)])
    none = F.array().cast("array<struct<label:string,containment:double>>")

    def of_block(r: Column) -> Column:
        def entries(token: Column, at: Column) -> Column:
            return F.filter(
                F.coalesce(F.element_at(lookup, token), F.array().cast("array<struct<t:int,p:int,size:int,need:int>>")),
                lambda c: (c["need"] <= F.size(r))
                & (at <= F.size(r) - c["need"])
                & (F.least(at, c["p"]) + 1 + F.least(F.size(r) - 1 - at, c["size"] - 1 - c["p"]) >= c["need"]),
            )

        candidates = F.array_distinct(
            F.transform(F.flatten(F.transform(r, entries)), lambda c: F.struct(c["t"].alias("t"), c["size"].alias("size"), c["need"].alias("need")))
        )
        verified = F.transform(
            candidates,
            lambda c: F.struct(
                c["t"].alias("t"), c["size"].alias("size"), c["need"].alias("need"),
                F.size(F.array_intersect(F.get(tokens_of, c["t"]), r)).alias("common"),
            ),
        )
        return F.transform(
            F.filter(verified, lambda c: c["common"] >= c["need"]),
            lambda c: F.struct(F.get(labels, c["t"]).alias("label"), (c["common"] / c["size"]).cast("double").alias("containment")),
        )

    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - (block // 2 + 1), F.lit(0)), F.lit(block // 2))
    blocks = F.transform(starts, lambda s: let(F.array_intersect(known, F.slice(words, s + 1, block)), of_block))
    return F.when(F.arrays_overlap(words, _strings(list(index))), F.array_distinct(F.flatten(blocks))).otherwise(none)


def phrase_places(words: Column, phrases: tuple[tuple[str, str], ...] = PHRASES) -> Column:
    """Struct of n_base, first_word, last_word and base (labels) over all places of the phrases."""
    joined = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))

    def look(body: Column) -> Column:
        counts, firsts, lasts, names = [], [], [], []
        for phrase, label in phrases:
            parts = phrase.split(" ")
            wanted = F.lit(" " + "  ".join(parts) + " ")
            there = body.contains(wanted)
            left = F.char_length(F.replace(body, wanted, F.lit("")))
            before = F.substr(body, F.lit(1), F.instr(body, wanted) - 1)
            after = F.substring_index(body, " " + "  ".join(parts) + " ", -1)
            words_in = lambda x: (F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit("")))) / 2
            counts.append(F.when(there, (F.char_length(body) - left) / len("  ".join(parts) + "  ")).otherwise(0.0))
            firsts.append(F.when(there, words_in(before).cast("long")))
            lasts.append(F.when(there, (F.size(words) - words_in(after) - len(parts)).cast("long")))
            names.append(F.when(there, F.lit(label)))
        return F.struct(
            sum(counts[1:], counts[0]).cast("long").alias("n_base"),
            F.array_min(F.array(*firsts)).alias("first_word"),
            F.array_max(F.array(*lasts)).alias("last_word"),
            F.array_compact(F.array(*names)).alias("base"),
        )

    return let(joined, look)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    Labels are distinct, sorted and joined by commas, empty without any. score is the
    highest containment, 1 where a phrase stands, 0 without a match. Null and empty
    texts have no words. Input columns of these names are replaced; rows stay as many
    as they are. Templates may have any number of words.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    own = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    order = word_order(docs, templates)
    sized: dict[int, list[Template]] = {}
    for template in templates:
        sized.setdefault(block_of(template[0], block), []).append(template)
    parts = [(size, tuple(own[k : k + chunk])) for size, own in sorted(sized.items()) for k in range(0, len(own), chunk)]

    def found(w: Column) -> Column:
        hits = [matches(w, part, order, threshold, size) for size, part in parts]
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            phrase_places(w).alias("places"),
            (F.concat(*hits) if len(hits) > 1 else hits[0]).alias("hits"),
        )

    text = let(scan_words(F.col("text")), found)
    base = F.col("_tl.places.base")
    return docs.withColumn("_tl", text).select(
        *own,
        "_tl.n_words",
        "_tl.places.n_base",
        "_tl.places.first_word",
        "_tl.places.last_word",
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(
            F.array_sort(F.array_distinct(F.concat(base, F.transform("_tl.hits", lambda h: h["label"])))), ","
        ).alias("labels"),
        F.greatest(
            F.when(F.size(base) > 0, 1.0).otherwise(0.0),
            F.coalesce(F.array_max(F.transform("_tl.hits", lambda h: h["containment"])), F.lit(0.0)),
        ).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the places of the phrases and the labels of matching templates."""
    return scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def oracle() -> str:
    """DuckDB SQL for the query: every block against every template, without filters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    values = ", ".join(
        f"([{', '.join(repr(w) for w in template_words(t))}], {need(len(template_words(t)), THRESHOLD)}, '{label}')" for t, label in TEMPLATES
    )
    phrases = ", ".join(f"({p.split(' ')!r}, '{label}')" for p, label in PHRASES)
    return f"""
    WITH d AS (
        SELECT doc_id, row_number() OVER () AS r,
               regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
        FROM documents
    ), t(tokens, need, label) AS (VALUES {values}), p(tokens, label) AS (VALUES {phrases}),
    spots AS (SELECT r, w, unnest(range(0, len(w))) AS i FROM d WHERE len(list_intersect(w, ['cc', 'general', 'all'])) > 0),
    places AS (SELECT r, i, label FROM spots, p WHERE w[i + 1 : i + len(tokens)] = tokens),
    base AS (
        SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
               list(DISTINCT label) AS labels FROM places GROUP BY r
    ),
    blocks AS (
        SELECT r, w[s + 1 : s + {BLOCK}] AS b
        FROM (SELECT r, w, unnest(range(0, greatest(len(w) - {BLOCK // 2}, 1), {BLOCK // 2})) AS s FROM d)
    ),
    hits AS (
        SELECT r, label, len(list_intersect(tokens, b)) / len(tokens) AS c
        FROM blocks, t WHERE len(list_intersect(tokens, b)) >= need
    ),
    own AS (SELECT r, list(DISTINCT label) AS labels, max(c) AS c FROM hits GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
           CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
           coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, own.labels))), ','), '') AS labels,
           CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
    FROM d LEFT JOIN base USING (r) LEFT JOIN own USING (r)
    """
