"""License scans: an exact containment join between blocks of text and license templates, beside fixed phrases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass.llm.common import cut, lower_ascii, text_or_empty

#: A word, of text in lower case: digits, letters and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are looked up as they stand, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Wordings of licenses, and their labels: what a page says in short, and what files carry on top.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    (
        "apache-2",
        "you may not use this file except in compliance with the license unless required by applicable law or agreed to in writing software distributed under the license "
        "is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
]
#: Percent of a template's distinct words that a block must hold.
PERCENT = 90
#: Templates of up to this many words are sought in the narrowest blocks; each wider kind is four times as wide.
NARROW = 16


def places(words: Column, phrase: str) -> Column:
    """Where, from word 0, the words of a phrase stand one after another."""
    own = phrase.split()
    here = lambda i: reduce(Column.__and__, [F.get(words, i + k) == w for k, w in enumerate(own)])
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def width_of(words: int) -> int:
    """Width of the blocks for a template of so many words."""
    width = NARROW
    while width < words:
        width *= 4
    return width


def by_width(templates: list[tuple[str, str]], percent: int) -> dict[int, list[tuple[int, str, list[str], int]]]:
    """Templates (number, label, distinct words, words that a block must hold) by the width of their blocks."""
    out: dict[int, list[tuple[int, str, list[str], int]]] = {}
    for k, (label, text) in enumerate(templates):
        words = sorted(set(text.split()))
        out.setdefault(width_of(len(text.split())), []).append((k, label, words, -(-percent * len(words) // 100)))
    return out


def blocks(words: Column, width: int, known: list[str]) -> Column:
    """Of every block, the known words that it holds. A block has 2 x width words and starts at every width-th:
    whatever is no longer than width lies whole in one."""
    last = F.greatest(F.ceil(F.size(words) / width).cast("int") - 2, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.array_intersect(_strings(known), F.slice(words, k * width + 1, 2 * width)))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def read(docs: DataFrame, phrases: dict[str, str], kinds: dict[int, list], id_col: str, text_col: str) -> DataFrame:
    """Per row of docs: id, h (128-bit hash of the text), n_words, places of phrases, their labels, and blocks_<width>."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("id", F.unhex(F.md5("text")).alias("h"), lower_ascii(F.col("text")).alias("text"))
    rows = rows.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    text, words = F.col("text"), F.col("words")
    found = {}
    for k, phrase in enumerate(phrases):
        # texts without these words as parts are told at once
        maybe = reduce(Column.__and__, [F.contains(text, F.lit(w)) for w in phrase.split()])
        found[f"at_{k}"] = F.when(maybe, places(words, phrase)).otherwise(F.array().cast("array<int>"))
    known = {w: sorted({x for t in of for x in t[2]}) for w, of in kinds.items()}
    out = rows.select("id", "h", F.size("words").cast("long").alias("n_words"), *[c.alias(n) for n, c in found.items()], *[blocks(words, w, known[w]).alias(f"blocks_{w}") for w in kinds])
    labels = F.array_compact(F.array(*[F.when(F.size(at) > 0, F.lit(label)) for at, label in zip(found, phrases.values(), strict=True)])) if phrases else F.array().cast("array<string>")
    at = F.concat(*[F.col(c) for c in found]) if phrases else F.array().cast("array<int>")
    return out.select("id", "h", "n_words", at.alias("at"), labels.alias("base"), *[f"blocks_{w}" for w in kinds])


def _index(spark: SparkSession, rank: dict[str, int], of: list[tuple[int, str, list[str], int]]) -> DataFrame:
    """(word, template, label, i, size, least, words): the prefix of each template, its rarest words. One row a word of the templates at most."""
    rows = []
    for number, label, words, least in of:
        ordered = sorted(words, key=rank.__getitem__)
        for i, word in enumerate(ordered[: len(words) - least + 1]):
            cells = {"word": word, "template": number, "label": label, "i": i, "size": len(words), "least": least}
            rows.append(F.struct(*[F.lit(v).alias(n) for n, v in cells.items()], _strings(ordered).alias("words")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def block_matches(rows: DataFrame, kinds: dict[int, list]) -> DataFrame:
    """(id, h, template, label, first_word, n_block_words, containment): every block that holds enough of a template.

    rows: a written table of read(). Words outside all templates can't count, so a block is the
    set of its template words. The order is that of their frequency over all blocks of all
    documents, rare ones first. A block can hold `least` of a template's words only if it has
    as many (length), if its words but for the last least - 1 and the template's likewise meet
    (prefix), and if, where they first meet, as many are left on both sides (position). What
    passes is counted on the whole sets. Templates are a parameter, so their prefixes, one row
    a word, are a broadcast of known size; no pair is listed but those that share a prefix word.
    """
    spark, out = rows.sparkSession, []
    for width, of in kinds.items():
        column = f"blocks_{width}"
        counts = rows.select(F.explode(F.flatten(column)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        seen = {r["word"]: r["n"] for r in counts.collect()}  # one row a word of the templates at most
        known = sorted({x for t in of for x in t[2]}, key=lambda w: (seen.get(w, 0), w))
        least = min(t[3] for t in of)
        numbered = F.transform(column, lambda b, k: F.struct(k.alias("k"), b.alias("words")))
        long_enough = F.filter(numbered, lambda b: F.size(b["words"]) >= least)  # noqa: B023
        each = rows.select("id", "h", F.explode(long_enough).alias("b")).select("id", "h", "b.k", F.array_intersect(_strings(known), F.col("b.words")).alias("own"))
        prefix = each.select("*", F.posexplode(F.slice("own", 1, F.size("own") - least + 1)).alias("j", "word"))
        met = prefix.join(F.broadcast(_index(spark, {w: i for i, w in enumerate(known)}, of)), "word")
        met = met.where(F.least(F.col("size") - F.col("i"), F.size("own") - F.col("j")) >= F.col("least"))
        common = F.size(F.array_intersect("own", "words"))
        met = met.select("id", "h", "template", "label", (F.col("k") * width).cast("long").alias("first_word"), F.lit(2 * width).alias("n_block_words"), "least", "size", common.alias("common"))
        met = met.where("common >= least").select("id", "h", "template", "label", "first_word", "n_block_words", (F.col("common") / F.col("size")).alias("containment"))
        out.append(met.groupBy(*met.columns).agg(F.count(F.lit(1)).alias("met")).drop("met"))
    return reduce(DataFrame.unionByName, out)


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    n_base counts the places of all phrases, first_word and last_word are their least and
    largest start; base_labels are the labels of phrases that occur, labels those and the
    labels of templates of which some block holds `percent` of the distinct words. score is the
    largest such share, 1 where a phrase occurs, 0 where nothing is found. blocks lists what
    matched: (label, first_word, n_block_words, containment), of at most one entry a template:
    its best block, the first of equals.

    Texts are read once and only once; what goes on, per row, is places and template words.
    Null texts are empty and without labels. Rows that repeat id and text get equal results;
    null ids are ids like any other. An empty table gives no rows; other columns, whatever
    their names, are not read.
    """
    kinds = by_width(TEMPLATES if templates is None else templates, percent)
    rows = cut(read(docs, PHRASES if phrases is None else phrases, kinds, id_col, text_col))
    best = block_matches(rows, kinds).groupBy("id", "h", "template", "label").agg(F.max_by(F.struct("first_word", "n_block_words", "containment"), F.struct("containment", -F.col("first_word"))).alias("b"))
    entry = F.struct("label", "b.first_word", "b.n_block_words", "b.containment")
    found = best.groupBy("id", "h").agg(F.array_sort(F.collect_list(entry)).alias("blocks"))
    found = found.select(F.col("id").alias("id_"), F.col("h").alias("h_"), "blocks")
    all_ = rows.drop(*[f"blocks_{w}" for w in kinds]).join(found, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left")
    matched = F.coalesce(F.transform("blocks", lambda b: b["label"]), F.array().cast("array<string>"))
    share = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return all_.select(
        F.col("id").alias(id_col), "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        text(F.col("base")).alias("base_labels"), text(F.concat("base", matched)).alias("labels"), F.when(F.size("at") > 0, F.lit(1.0)).otherwise(share).alias("score"), "blocks",
    )
