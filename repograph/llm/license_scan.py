"""License scans by a positional rare-token index (operator 3), in DataFrame functions only.

Templates are licence notices and sentences of the licences themselves, with mandatory key phrases. How many documents hold
each of their words is counted over all documents; of each template the RARE words with the highest IDF are indexed, with
postings (template, place). Every indexed word that a document holds is looked up: each of its places, less the place in a
posting, is where that template would begin. Where enough different words agree on the beginning, the template's key
phrases are compared with the words that must then stand there. A template whose phrases all stand labels the document;
the score is the highest share, weighted by IDF, of a template's words that stand in their places.

Base labels need no index: they are the places of BASE phrases. They stay whatever the method says.

The vocabulary, its counts and the index are as large as the templates, whatever the data; nothing is shuffled but one
count a word. Defined cases: a null or empty text has no words; repeated rows get equal rows; an empty table gives an
empty one; places are counted in whole texts; of ties in IDF the smaller word comes first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.llm.textmap import free_names

RARE = 4
#: So many different indexed words must agree on where a template begins.
AGREE = 2

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    phrases: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def places(self) -> list[tuple[int, list[str]]]:
        """Where each key phrase stands in the notice."""
        out = []
        for phrase in self.phrases:
            p = phrase.split()
            out.append((next(i for i in range(len(self.words)) if self.words[i : i + len(p)] == p), p))
        return out


#: Notices and sentences of the licences themselves, as words.
NOTICES = (
    Notice("mit", "released under the mit license", ("mit license",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge",)),
    Notice("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Notice("gpl", "licensed under the gnu general public license version", ("gnu general public license",)),
    Notice("lgpl", "licensed under the gnu lesser general public license version", ("gnu lesser general public license",)),
    Notice("mpl", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms", "with or without modification")),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "hereby granted")),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    # sentences of the full texts, each of which tells the licence
    Notice("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included", "substantial portions of the software")),
    Notice("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license", "www apache org licenses")),
    Notice("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("redistribute it and or modify it", "gnu general public license")),
    Notice("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("redistribute it and or modify it", "gnu lesser general public license")),
    Notice("mpl", "this source code form is subject to the terms of the mozilla public license", ("source code form", "mozilla public license")),
    Notice("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code", "this list of conditions")),
    Notice("isc", "provided that the above copyright notice and this permission notice appear in all copies", ("this permission notice appear in all copies",)),
    Notice("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty", "held liable")),
    Notice("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Notice("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """A-Z lower-cased; runs of digits, letters and characters that aren't ASCII."""
    clean = F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    return F.filter(F.split(clean, " ", -1), lambda w: w != "")


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def inverse_frequencies(words: DataFrame, notices: tuple[Notice, ...]) -> dict[str, float]:
    """log((documents + 1) / (those with the word + 1)) of every word of the notices, from all rows of ``words``."""
    vocabulary = sorted({w for n in notices for w in n.words})
    marker = F.array(F.lit(""))  # no word is empty: it counts the documents
    held = words.select(F.explode(F.concat(marker, F.array_intersect("words", _strings(vocabulary)))).alias("word"))
    counts = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}  # a row for a word of the notices
    total = counts.get("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def index_of(notices: tuple[Notice, ...], idf: dict[str, float], rare: int = RARE) -> dict[str, list[tuple[int, int]]]:
    """Postings (notice, place) of each notice's rarest words."""
    out: dict[str, list[tuple[int, int]]] = {}
    for n, notice in enumerate(notices):
        for word in sorted(set(notice.words), key=lambda w: (-idf[w], w))[:rare]:
            out.setdefault(word, []).extend((n, p) for p, w in enumerate(notice.words) if w == word)
    return out


def _base_places(words: Column, base: dict[str, str]) -> Column:
    """(start, label) of each place of a base phrase."""

    def stands(i: Column, phrase: list[str]) -> Column:
        out = F.lit(True)
        for k, w in reversed(list(enumerate(phrase))):
            out = (F.get(words, i + k) == w) & out
        return out

    def at(w: Column, i: Column) -> Column:
        none = F.array().cast("array<struct<start:int,label:string>>")
        found = [F.when(stands(i, p.split()), F.array(F.struct(i.cast("int").alias("start"), F.lit(label).alias("label")))).otherwise(none) for p, label in base.items()]
        return F.when(w.isin(*{p.split()[0] for p in base}), F.concat(*found)).otherwise(none)

    return F.flatten(F.filter(F.transform(words, at), lambda x: F.size(x) > 0))


def scan(
    documents: DataFrame,
    *,
    keep: list[str],
    text: str = "text",
    notices: tuple[Notice, ...] = NOTICES,
    base: dict[str, str] | None = None,
    rare: int = RARE,
    agree: int = AGREE,
) -> DataFrame:
    """The ``keep`` columns (one named like a result as ``input_`` and the name), n_words, places (start, label) of base phrases,
    matches (label, start, share), score."""
    base = BASE if base is None else base
    kept = [F.col(f"`{c}`") for c in keep]
    names = [f"__keep{i}" for i in range(len(keep))]  # so that no column of the rows clashes with those made here
    source = documents.select(*(c.alias(n) for c, n in zip(kept, names)), words_of(F.col(f"`{text}`")).alias("words"))
    idf = inverse_frequencies(source, notices)
    index = index_of(notices, idf, rare)
    ordered = sorted(index, key=lambda w: (-idf[w], w))
    postings = F.create_map(
        *(x for w in ordered for x in (F.lit(w), F.array(*(F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")) for n, p in index[w]))))
    )
    need = F.array(*(F.lit(min(agree, rare, len(set(n.words)))) for n in notices))

    held = F.array_intersect(_strings(ordered), "words")
    base_words = [p.split()[-1] for p in base]
    rows = source.select(
        *names,
        "words",
        F.size("words").cast("long").alias("n_words"),
        held.alias("found"),
        F.arrays_overlap("words", _strings(base_words)).alias("may_base"),
    )
    no_votes = F.array().cast("array<struct<n:int,start:int,w:string>>")

    def vote(w: Column, i: Column) -> Column:
        own = F.transform(F.element_at(postings, w), lambda q: F.struct(q["n"].alias("n"), (i - q["p"]).alias("start"), w.alias("w")))
        return F.when(F.array_contains("found", w), own).otherwise(no_votes)

    votes = F.when(F.size("found") > 0, F.array_sort(F.flatten(F.filter(F.transform("words", vote), lambda x: F.size(x) > 0)))).otherwise(no_votes)
    rows = rows.select(
        *names, "words", "n_words", votes.alias("votes"),
        F.when(F.col("may_base"), _base_places(F.col("words"), base)).otherwise(F.array().cast("array<struct<start:int,label:string>>")).alias("places"),
    )
    # votes are in order, so those for one beginning stand together, and one word votes there once
    kind = "struct<n:int,start:int,count:int,out:array<struct<n:int,start:int>>>"
    zero = F.struct(F.lit(-1).alias("n"), F.lit(0).alias("start"), F.lit(0).alias("count"), F.array().cast("array<struct<n:int,start:int>>").alias("out")).cast(kind)

    def tally(acc: Column, v: Column) -> Column:
        same = (acc["n"] == v["n"]) & (acc["start"] == v["start"])
        count = F.when(same, acc["count"] + 1).otherwise(F.lit(1))
        here = F.array(F.struct(v["n"].alias("n"), v["start"].alias("start")))
        reached = count == F.element_at(need, v["n"] + 1)
        return F.struct(v["n"].alias("n"), v["start"].alias("start"), count.alias("count"), F.when(reached, F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out")).cast(kind)

    candidates = F.when(F.size("votes") > 0, F.aggregate(F.array_distinct("votes"), zero, tally, lambda acc: acc["out"])).otherwise(
        F.array().cast("array<struct<n:int,start:int>>")
    )
    rows = rows.select(*names, "words", "n_words", "places", candidates.alias("candidates"))
    phrases = F.array(
        *(F.array(*(F.struct(F.lit(p).alias("at"), F.lit(len(w)).alias("size"), F.lit(" ".join(w)).alias("phrase")) for p, w in n.places())) for n in notices)
    )
    texts = F.array(*(F.array(*(F.struct(F.lit(w).alias("w"), F.lit(float(idf[w])).alias("idf")) for w in n.words)) for n in notices))
    totals = F.array(*(F.lit(float(sum(idf[w] for w in n.words)) or 1.0) for n in notices))
    labels = _strings([n.label for n in notices])

    def stands(c: Column) -> Column:
        def phrase(p: Column) -> Column:
            start = c["start"] + p["at"]
            return F.when(start < 0, F.lit(False)).otherwise(F.array_join(F.slice("words", start + 1, p["size"]), " ") == p["phrase"])

        return F.forall(F.element_at(phrases, c["n"] + 1), phrase)

    def share(c: Column) -> Column:
        def weight(t: Column, j: Column) -> Column:
            at = c["start"] + j
            return F.when((at >= 0) & (F.get("words", at) == t["w"]), t["idf"]).otherwise(F.lit(0.0))

        total = F.aggregate(F.transform(F.element_at(texts, c["n"] + 1), weight), F.lit(0.0), lambda s, x: s + x)
        return F.least(F.lit(1.0), total / F.element_at(totals, c["n"] + 1))

    match = lambda c: F.struct(F.element_at(labels, c["n"] + 1).alias("label"), c["start"].alias("start"), share(c).alias("share"))
    some = F.size("candidates") > 0
    none = F.array().cast("array<struct<label:string,start:int,share:double>>")
    matches = F.when(some, F.transform(F.filter("candidates", stands), match)).otherwise(none)
    rows = rows.select(*names, "n_words", "places", matches.alias("matches"))
    return rows.select(
        *(F.col(n).alias(c) for n, c in zip(names, free_names(keep, ["n_words", "places", "matches", "score"]))),
        "n_words",
        "places",
        "matches",
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    every = F.concat(base, F.transform("matches", lambda m: m["label"]))
    told = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        told(base).alias("base_labels"),
        told(every).alias("labels"),
        "score",
    )
