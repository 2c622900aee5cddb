"""License scans by a positional index of rare tokens.

A template is a licence: its label and the passages that must all stand in a text, word by word. The index
posts each template word at its offset in each passage. One pass over the texts keeps, of their words, only the
template words with their places, as a written table; all else works on that. Document frequencies of the
template words order them. Of each text the template words it has are looked up from the rarest on; a passage
is a candidate where its two rarest words are present. Their places among the kept words, less their offsets in
the passage, are intersected, and at each start left the whole passage is verified: its words, one after another
in the text. All words of a passage are mandatory, so a text without one of the two rarest cannot hold it: no place is lost.

Results: words are runs of characters other than ASCII controls, punctuation and capitals after A-Z are
lower-cased. A null or empty text has no words, no places, no labels and score 0. Very long texts count whole.
Passages that overlap are found each; words that are as rare go by name. Repeated rows are scanned each; an
empty table gives no rows. Columns not asked for are not read. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.runtime import materialize, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Key phrases and labels of the base, and the templates that the method adds (label, mandatory passages).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
ADDED = [
    ("agpl", ["affero general public license"]),
    ("apache", ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"]),
    ("bsd", ["bsd license"]),
    ("bsd", ["redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"]),
    ("cc-by", ["cc by"]),
    ("cc-by-nc", ["cc by nc"]),
    ("cc-by-sa", ["cc by sa"]),
    ("epl", ["eclipse public license"]),
    ("gpl", ["this program is free software you can redistribute it and or modify it", "under the terms of the gnu general public license"]),
    ("isc", ["isc license"]),
    ("isc", ["permission to use copy modify and or distribute this software for any purpose", "the author disclaims all warranties with regard to this software"]),
    ("lgpl", ["lesser general public license"]),
    ("mit", ["permission is hereby granted free of charge to any person obtaining a copy", "the software is provided as is without warranty of any kind"]),
    ("mpl", ["mozilla public license"]),
    ("mpl", ["this source code form is subject to the terms of the mozilla public license"]),
    ("unlicense", ["free and unencumbered software"]),
]
TEMPLATES = [(label, [phrase]) for phrase, label in BASE.items()] + ADDED
PASSAGES = list(dict.fromkeys(p for _, ps in TEMPLATES for p in ps))
VOCABULARY = sorted({w for p in PASSAGES for w in p.split()})


def words(text: Column) -> Column:
    """The words of a text, as an array."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


def _strings(values: list[str]) -> Column:
    return F.split(F.lit(" ".join(values)), " ")  # folded to a constant


def postings(docs: DataFrame, keep: list[str], names: tuple[str, str, str], text: str = "text") -> DataFrame:
    """``keep`` columns, the number of words, and the places (from 0) of the template words of each text and these words. ``names``: those of the last three."""
    every = words(F.col(f"`{text}`"))
    # The words are made once: a lambda's argument is not evaluated anew where it is used.
    hits = F.transform(F.array(every), lambda ws: F.struct(F.size(ws).alias("n"), F.array_compact(F.transform(ws, lambda w, i: F.when(w.isin(VOCABULARY), F.struct(i.alias("at"), w.alias("word"))))).alias("hits")))
    kept = [F.col(f"`{c}`") for c in keep]
    held = unused("v_made", keep)
    found = docs.select(*kept, F.get(hits, 0).alias(held))
    return found.select(*kept, *[F.col(f"{held}.{x}").alias(n) for x, n in zip(("n", "hits.at", "hits.word"), names, strict=True)])


def frequencies(posted: DataFrame, word: str) -> dict[str, int]:
    """In how many texts each word of the templates occurs."""
    present = F.explode(F.array_distinct(word)).alias("word")
    found = posted.select(present).groupBy("word").agg(F.count("*").alias("n"))
    return dict.fromkeys(VOCABULARY, 0) | {r["word"]: r["n"] for r in found.collect()}  # a row for each template word


def _starts(passage: list[str], rarity: list[str], at: str, word: str, rare: str) -> Column:
    """Places (from 0) of a passage, from those of its two rarest words."""
    n = len(passage)
    first, second = sorted(range(n), key=lambda k: (rarity.index(passage[k]), k))[:2]

    def begins(k: int) -> Column:
        """Where among the kept words the passage would begin, by its word k."""
        return F.array_compact(F.transform(word, lambda w, i: F.when(w == passage[k], i - F.lit(k))))

    def stands(i: Column) -> Column:
        consecutive = F.get(at, i + (n - 1)) - F.get(at, i) == n - 1
        return (i >= 0) & F.coalesce(consecutive, F.lit(False)) & (F.slice(word, i + 1, n) == _strings(passage))

    held = F.array_contains(rare, passage[first]) & F.array_contains(rare, passage[second])
    near = F.array_intersect(begins(first), begins(second))
    exact = F.transform(F.filter(near, stands), lambda i: F.get(at, i))
    return F.when(held, exact).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, n_words, n_base, first_word, last_word, base_labels, labels and score.

    The score is 1 where a template stands, else half the largest share of a template's distinct words that the text has.
    """
    size, at, word, rare = (unused(n, keep) for n in ("v_words", "v_at", "v_word", "v_rare"))
    posted = materialize(postings(docs, keep, (size, at, word), text), "postings")
    counts = frequencies(posted, word)
    rarity = sorted(counts, key=lambda w: (counts[w], w))
    looked = posted.withColumn(rare, F.array_intersect(_strings(rarity), F.col(word)))
    names = {p: unused(f"v_at{k}", keep) for k, p in enumerate(PASSAGES)}
    found = looked.select("*", *[_starts(p.split(), rarity, at, word, rare).alias(names[p]) for p in PASSAGES])

    def stands(passages: list[str]) -> Column:
        out = F.lit(True)
        for p in passages:
            out = out & (F.size(names[p]) > 0)
        return out

    def labels(of: list[tuple[str, list[str]]]) -> Column:
        each = F.array(*[F.when(stands(passages), F.lit(label)) for label, passages in of])
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.array_compact(each))))

    base = F.concat(*[F.col(names[p]) for p in BASE])
    of = [sorted({w for p in passages for w in p.split()}) for _, passages in TEMPLATES]
    shares = [F.lit(0.5) * F.size(F.array_intersect(_strings(ws), F.col(rare))) / F.lit(float(len(ws))) for ws in of]
    return found.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(size).cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"),
        F.array_max(base).cast("long").alias("last_word"),
        labels(TEMPLATES[: len(BASE)]).alias("base_labels"),
        labels(TEMPLATES).alias("labels"),
        F.when(F.exists(F.array(*[stands(ps) for _, ps in TEMPLATES]), lambda x: x), F.lit(1.0)).otherwise(F.greatest(*shares)).alias("score"),
    )
