"""Licence scan by a positional rare-token index (operator 2, native).

The index holds, for each word of the templates, its postings (template, position). A file looks up
those licence words it contains that are rarest over the corpus; every posting met at word i votes for
the alignment i - position of its template. Votes that meet in one alignment are the intersection of
the postings by relative position; there the template's mandatory key phrase is verified word by word.
All of it happens inside the row: no text is shuffled. The one corpus statistic, document frequency of
the index words, has as many rows as the index has words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, let, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words: every ASCII character but digits and lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that count wherever their words stand consecutively.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: (template text, its mandatory key phrase, label)
TEMPLATES = (
    ("released under the mit license", "mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge", "mit"),
    ("licensed under the apache license version 2 0", "apache license version 2", "apache-2.0"),
    ("licensed under the gnu general public license version 2", "general public license version 2", "gpl-2"),
    ("this work is licensed under the gnu general public license version 3", "general public license version 3", "gpl-3"),
    ("under the terms of the gnu lesser general public license", "lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license v 2 0", "mozilla public license", "mpl"),
    ("made available under the terms of the eclipse public license", "eclipse public license", "epl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software", "isc"),
    ("licensed under cc by 4 0", "licensed under cc by 4", "cc-by"),
    ("licensed under cc by sa 4 0", "cc by sa", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc by nc", "cc-by-nc"),
    ("this is free and unencumbered software released into the public domain", "free and unencumbered software", "unlicense"),
)
#: How many of its rarest licence words a file looks up, besides those of the base phrases and the two rarest of each key
#: phrase whose words it has; so no key phrase is missed, however many licences a file names.
RARE = 16


class Index:
    """Postings, key phrases and labels of the templates; base phrases are templates that are their own key phrase."""

    def __init__(self, base=BASE, templates=TEMPLATES):
        self.rows = [(p, p, label, True) for p, label in base] + [(t, p, label, False) for t, p, label in templates]
        self.words = [t.split() for t, *_ in self.rows]
        self.keys = [p.split() for _, p, *_ in self.rows]
        self.at = []
        for (text, phrase, label, _), words, key in zip(self.rows, self.words, self.keys, strict=True):
            starts = [i for i in range(len(words)) if words[i : i + len(key)] == key]
            if not starts or len(set(key)) < 2:
                raise ValueError(f"template of {label}: a key phrase of two different words at least inside it: {text!r}, {phrase!r}")
            self.at.append(starts[0])
        self.postings: dict[str, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            for i, w in enumerate(words):
                self.postings.setdefault(w, []).append((t, i))
        self.lexicon = sorted(self.postings)
        self.base_words = sorted({w for (*_, is_base), ws in zip(self.rows, self.words, strict=True) if is_base for w in ws})


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP), "")


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def document_frequency(docs: DataFrame, index: Index, text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each index word stands, and how many documents there are. At most one row for each index word."""
    seen = docs.select(F.explode(F.array_intersect(tokens(text_of(text_col)), strings(index.lexicon))).alias("w"))
    return {r["w"]: r["count"] for r in seen.groupBy("w").count().collect()}, docs.count()


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES, rare: int = RARE) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    places: array of (label, start, is_base), every verified place. Words are runs of a-z, 0-9 and non-ASCII
    characters after lower-casing A-Z. n_base counts all places of the base phrases; first_word and last_word are
    their smallest and largest start (null without one). A template gives its label where at least two looked-up
    words agree on an alignment and its key phrase stands there; score is the best share of template words
    matched at such an alignment, or 1 for a base phrase, else 0. A null or empty text has no words, no labels
    (empty strings) and score 0. Repeated rows give repeated results; other columns are not read.
    """
    index = Index(base, templates)
    df, n = document_frequency(docs, index, text_col)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in index.lexicon}
    order = {w: i for i, w in enumerate(sorted(index.lexicon, key=lambda w: (-idf[w], w)))}
    # The two rarest words of each key phrase: where a phrase stands, both vote for its alignment.
    rarest = [sorted(set(key), key=lambda w: order[w])[:2] for key in index.keys]
    phrases = F.array(*[F.struct(strings(key).alias("key"), strings(two).alias("two")) for key, two in zip(index.keys, rarest, strict=True)])
    rank = F.create_map(*[x for w in index.lexicon for x in (F.lit(w), F.lit(order[w]))])
    posting = F.create_map(
        *[x for w in index.lexicon for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in index.postings[w]]))]
    )
    need = F.array(*[F.lit(len(ws) if is_base else 2) for (*_, is_base), ws in zip(index.rows, index.words, strict=True)])
    about = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.lit(is_base).alias("is_base"), strings(ws).alias("words"), strings(key).alias("key"), F.lit(at).alias("at"))
            for (_, _, label, is_base), ws, key, at in zip(index.rows, index.words, index.keys, index.at, strict=True)
        ]
    )

    def votes(words: Column, present: Column) -> Column:
        """(template, alignment) of every posting met, sorted."""
        ranked = F.array_sort(F.transform(present, lambda w: F.struct(F.element_at(rank, w).alias("r"), w.alias("w"))))
        told = F.flatten(F.transform(F.filter(phrases, lambda p: F.size(F.array_except(p["key"], present)) == 0), lambda p: p["two"]))
        look_up = F.array_union(F.array_union(F.transform(F.slice(ranked, 1, rare), lambda s: s["w"]), told), F.array_intersect(present, strings(index.base_words)))

        def met(look: Column) -> Column:
            hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: F.array_contains(look, s["w"]))
            return F.flatten(F.transform(hits, lambda s: F.transform(F.element_at(posting, s["w"]), lambda p: F.struct(p["t"].alias("t"), (s["i"] - p["i"]).alias("d")))))

        return F.array_sort(let(look_up, met))

    def agreed(v: Column) -> Column:
        """The alignments with votes enough: the element that is the need-th of its run."""

        def enough(x: Column, k: Column) -> Column:
            m = F.element_at(need, x["t"] + 1)
            return (k + 1 >= m) & (F.get(v, k - m + 1) == x) & ((k < m) | (F.get(v, k - m) != x))

        return F.filter(v, enough)

    def verified(words: Column, found: Column) -> Column:
        def place(x: Column) -> Column:
            def at(a: Column) -> Column:
                start = x["d"] + a["at"]
                stands = (start >= 0) & F.forall(F.transform(a["key"], lambda w, j: F.get(words, F.greatest(start, F.lit(0)) + j).eqNullSafe(w)), lambda ok: ok)
                share = F.size(F.filter(F.transform(a["words"], lambda w, j: F.when(x["d"] + j >= 0, F.get(words, F.greatest(x["d"] + j, F.lit(0)))).eqNullSafe(w)), lambda ok: ok)) / F.size(a["words"])
                return F.struct(a["label"].alias("label"), start.alias("start"), a["is_base"].alias("is_base"), F.when(stands, share).alias("share"))

            return let(F.element_at(about, x["t"] + 1), at)

        return F.filter(F.transform(found, place), lambda p: p["share"].isNotNull())

    split = docs.select(column(id_col).alias("doc_id"), tokens(text_of(text_col)).alias("words"))
    seen = split.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", strings(index.lexicon)).alias("present"))
    worth = None
    for key in {tuple(k) for k in index.keys}:
        has = F.size(F.array_except(strings(key), F.col("present"))) == 0
        worth = has if worth is None else worth | has
    none = F.array().cast("array<struct<label:string,start:int,is_base:boolean,share:double>>")
    found = let(F.col("words"), lambda w: verified(w, let(votes(w, F.col("present")), agreed)))
    placed = seen.select("doc_id", "n_words", F.when((F.size("present") > 1) & worth, found).otherwise(none).alias("places"))
    own = F.filter("places", lambda p: p["is_base"])
    starts = F.transform(own, lambda p: p["start"].cast("long"))
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda p: p["label"]))), ",")
    return placed.select(
        "doc_id", "n_words", F.size(own).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(own).alias("base_labels"),
        names(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
        F.transform("places", lambda p: F.struct(p["label"].alias("label"), p["start"].cast("long").alias("start"), p["is_base"].alias("is_base"))).alias("places"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return license_scan(docs).drop("places")
