"""License scans by a positional rare-token index, in DataFrame functions alone.

Templates are fixed texts: full notices and the short grants of one line. The index holds a posting
for every place of every template's words, and each word's inverse document frequency over all
documents. A file looks up its own rarest words: of each template's words, the `LOOKUPS` with the
highest idf that the file holds, so that a notice is found by whatever part of it stands there. Each
place of such a word minus a posting's place is an offset, and words that stand in the file as they
stand in the template agree on one offset, give or take `GAP` inserted or missing words: offsets fall
into two overlapping grids of cells, and the distinct words that meet in one cell count. Their weight
(sum of idf) as a share of all looked-up words' is the template's alignment. A template counts if its
alignment reaches `ALIGNED` and each of its mandatory key phrases stands in the file word for word.

The score is the largest weight that met, as a share of the weight of the template's rarest words
that the corpus holds: 1 for a whole notice, less for a part of one. It comes from the alignment for
every file, those with a base phrase included. Alignment and score are rounded to six decimals.

Besides, the places of fixed base phrases are counted, and give labels of their own.

A file costs one pass over its words and a sort of its hits; there is no shuffle but for document
frequencies, which are as many rows as the templates have words.

Defined results: a null or empty text has no words, no labels and score 0. Rows with a null id and
repeated rows get a row each. An empty table gives an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilesieve.llm.common import with_id_and_text

#: Characters between words, where A-Z may still be upper case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose places are counted, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices and grants of public licenses in words: label, text, mandatory key phrases.
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "in compliance with the license")),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "spdx license identifier apache 2 0", ("spdx license identifier apache",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "with or without modification")),
    ("bsd", "licensed under the bsd license", ("bsd license",)),
    ("bsd", "spdx license identifier bsd 3 clause", ("spdx license identifier bsd",)),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", ("cc by nc nd 4 0",)),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software", "general public license")),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "spdx license identifier gpl 3 0", ("spdx license identifier gpl",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "spdx license identifier mit", ("spdx license identifier mit",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("public domain",)),
)

LOOKUPS = 8
GAP = 2
ALIGNED = 0.5


@dataclass(frozen=True)
class Template:
    """A template's postings (word, place), its words by falling idf with it, and the weight of the rarest that the corpus holds."""

    label: str
    postings: tuple[tuple[str, int], ...]
    rarest: tuple[tuple[str, float], ...]
    weight: float
    phrases: tuple[str, ...]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def build_index(docs: DataFrame, templates: tuple[tuple[str, str, tuple[str, ...]], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", lookups: int = LOOKUPS) -> list[Template]:
    """The index of the templates' words, by document frequencies over all of docs; a word that no document holds is never looked up."""
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()})
    words = F.split(F.translate("text", UPPER, LOWER), BETWEEN)
    held = with_id_and_text(docs, id_col, text_col).select(F.explode(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("word"))
    df = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}  # at most as many rows as the templates have words
    total = docs.count()
    idf = {w: math.log((1 + total) / (1 + df[w])) + 1e-9 for w in vocabulary if w in df}
    out = []
    for label, text, phrases in templates:
        rarest = tuple((w, idf[w]) for w in sorted({*text.split()} & idf.keys(), key=lambda w: (-idf[w], w)))
        out.append(Template(label, tuple((w, i) for i, w in enumerate(text.split()) if w in idf), rarest, sum(v for _, v in rarest[:lookups]), phrases))
    return out


def _stands(phrase: str, at: Column) -> Column:
    """The phrase's words stand from there on."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.get(F.col("words"), at + k) == w, F.lit(False)) for k, w in enumerate(phrase.split())])


def _places(phrase: str) -> Column:
    first = phrase.split()[0]
    return F.transform(F.filter("placed", lambda x: (x["w"] == first) & _stands(phrase, x["at"])), lambda x: x["at"])


def _met(t: Template, gap: int, lookups: int) -> Column:
    """Struct: weight of the template's words that the file looks up, and the largest weight of distinct ones that meet in one cell of offsets."""
    weights = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(v).alias("v")) for w, v in t.rarest))
    own = F.slice(F.filter(weights, lambda x: F.array_contains("held", x["w"])), 1, lookups)
    width = 2 * (gap + 1)
    posts = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(i).alias("i"), F.lit(v).alias("v")) for w, i in t.postings for u, v in t.rarest if u == w))

    def cells(x: Column, q: Column) -> Column:
        offset = x["at"] - q["i"]
        cell = lambda grid: (F.floor((offset + grid * (gap + 1)) / width) * 2 + grid).cast("int")
        return F.array(*(F.struct(cell(g).alias("d"), q["w"].alias("w"), q["v"].alias("v")) for g in (0, 1)))

    def votes(found: Column) -> Column:
        names = F.transform(found, lambda y: y["w"])
        mine = F.filter("placed", lambda x: F.array_contains(names, x["w"]))
        return F.array_sort(F.flatten(F.flatten(F.transform(mine, lambda x: F.transform(F.filter(posts, lambda q: q["w"] == x["w"]), lambda q: cells(x, q))))))

    zero = F.struct(F.lit(None).cast("int").alias("d"), F.lit(None).cast("string").alias("w"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def add(acc: Column, x: Column) -> Column:
        same = F.coalesce(acc["d"] == x["d"], F.lit(False))
        now = F.when(same & (acc["w"] == x["w"]), acc["sum"]).otherwise(F.when(same, acc["sum"]).otherwise(F.lit(0.0)) + x["v"])
        return F.struct(x["d"].alias("d"), x["w"].alias("w"), now.alias("sum"), F.greatest(acc["best"], now).alias("best"))

    best = F.aggregate(votes(own), zero, add)["best"]
    return F.struct(F.aggregate(own, F.lit(0.0), lambda a, x: a + x["v"]).alias("looked"), best.alias("best"))


def scan(docs: DataFrame, index: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text", aligned: float = ALIGNED, gap: int = GAP, lookups: int = LOOKUPS) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    index = build_index(docs, id_col=id_col, text_col=text_col, lookups=lookups) if index is None else index
    index = [t for t in index if t.rarest and all(w in dict(t.rarest) for p in t.phrases for w in p.split())]  # without its phrases' words no file can hold it
    wanted = sorted({w for p in BASE_PHRASES for w in p.split()} | {w for t in index for w, _ in t.postings})
    # a base phrase and every key phrase end in one of these words; without one there is nothing to find
    needed = sorted({p.split()[-1] for p in BASE_PHRASES} | {t.phrases[0].split()[-1] for t in index})
    text = F.coalesce("text", F.lit(""))
    got = with_id_and_text(docs, id_col, text_col).select("doc_id", text.alias("text"))
    got = got.select("doc_id", _words(F.translate("text", UPPER, LOWER)).alias("words"))
    none = F.array().cast("array<string>")
    got = got.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.arrays_overlap("words", F.array(*map(F.lit, needed))), F.col("words")).otherwise(none).alias("words"))
    got = got.withColumn("placed", F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda x: x["w"].isin(wanted)))
    got = got.withColumn("held", F.array_distinct(F.transform("placed", lambda x: x["w"])))
    nothing = F.lit(None).cast("struct<looked:double,best:double>")
    stand = lambda t: reduce(lambda a, b: a & b, [F.size(_places(p)) > 0 for p in t.phrases])
    may = lambda t: reduce(lambda a, b: a & b, [F.array_contains("held", w) for w in sorted({w for p in t.phrases for w in p.split()})])
    got = got.select("*", *(_places(p).alias(label) for p, label in BASE_PHRASES.items()), *(F.when(may(t), F.when(stand(t), _met(t, gap, lookups))).otherwise(nothing).alias(f"t{k}") for k, t in enumerate(index)))
    accepted = [F.coalesce(F.round(F.col(f"t{k}.best") / F.col(f"t{k}.looked"), 6) >= aligned, F.lit(False)) for k in range(len(index))]
    base = [F.when(F.size(x) > 0, F.lit(x)) for x in BASE_PHRASES.values()]
    more = [F.when(ok, F.lit(t.label)) for ok, t in zip(accepted, index)]
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*xs)))), ",")
    scores = [F.when(ok, F.round(F.col(f"t{k}.best") / F.lit(t.weight), 6)).otherwise(0.0) for k, (ok, t) in enumerate(zip(accepted, index))]
    every = F.concat(*BASE_PHRASES.values())
    return got.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(base + more).alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.0), *scores)).alias("score"),
    )
