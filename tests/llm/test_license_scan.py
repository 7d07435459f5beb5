import math
import re

import pytest

from repograph.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ROWS = [
    (1, "Released under the MIT License. MIT  license!"),
    (2, "x Licensed under the Apache License, Version 2.0 y"),
    (3, "This work is licensed under the GNU General Public License, version 3."),
    (4, "Licensed under CC BY-NC 4.0."),
    (5, "the apache of the license under mit"),
    (6, None),
    (7, ""),
    (8, "été MİT license – Général public license. General\nPublic\tLicense"),
    (8, "été MİT license – Général public license. General\nPublic\tLicense"),
    (None, "licensed under cc by sa 4 0 " * 50 + "mit license"),
    (9, "by nc 4 0"),
    (10, " ".join(["plain"] * 30000) + " mit license"),
]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, notices=ls.NOTICES):
    """By the docstring's rules, from the words."""
    every = [words(t) for t in texts]
    idf = {w: math.log((len(texts) + 1) / (sum(w in x for x in every) + 1)) for n in notices for w in n.words}
    index = {}
    for n, notice in enumerate(notices):
        for w in sorted(set(notice.words), key=lambda w: (-idf[w], w))[: ls.RARE]:
            index.setdefault(w, []).extend((n, p) for p, x in enumerate(notice.words) if x == w)
    for w in every:
        base = [(i, label) for phrase, label in ls.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        found = set(w) & set(index)
        votes = {}
        for i, x in enumerate(w):
            if x in found:
                for n, p in index[x]:
                    votes.setdefault((n, i - p), set()).add(x)
        labels, score = set(), 0.0
        for (n, start), agreed in votes.items():
            notice = notices[n]
            ok = len(agreed) >= min(ls.AGREE, len(set(notice.words)))
            if ok and all(start + p >= 0 and w[start + p : start + p + len(q)] == q for p, q in notice.places()):
                labels.add(notice.label)
                own = sum(idf[x] for j, x in enumerate(notice.words) if 0 <= start + j < len(w) and w[start + j] == x)
                score = max(score, min(1.0, own / (sum(idf[x] for x in notice.words) or 1.0)))
        yield {
            "n_words": len(w),
            "n_base": len(base),
            "first_word": min((i for i, _ in base), default=None),
            "last_word": max((i for i, _ in base), default=None),
            "base_labels": ",".join(sorted({x for _, x in base})),
            "labels": ",".join(sorted({x for _, x in base} | labels)),
            "score": pytest.approx(score),
        }


def check(spark, path, rows):
    got = sorted((r.asDict() for r in ls.op3_license_scan(spark, path).collect()), key=str)
    want = sorted(({"doc_id": i} | w for (i, _), w in zip(rows, brute([t for _, t in rows]))), key=str)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_words"])
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def test_same_as_brute_force(spark, tmp_path):
    spark.createDataFrame([(*r, "c") for r in ROWS], "doc_id long, text string, words string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in check(spark, str(tmp_path), ROWS)}
    assert got[4]["labels"] == "cc-by-nc" and got[2]["labels"] == "apache" and got[5]["labels"] == "" and got[1]["n_base"] == 2
    assert got[None]["labels"] == "cc-by-sa,mit"


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ls.scan(df, keep=["doc_id"]).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert any(r["labels"] for r in check(spark, sf, rows))


def test_no_python_in_the_plan(spark):
    plan = ls.op3_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_every_notice_of_a_text_is_found(spark, tmp_path):
    """However many notices a text holds, none is left out for the words of others."""
    some = ("permission is hereby granted free", "subject to the terms", "redistribution and use", "permission to use copy", "this is free")
    rows = [(1, " plain words between ".join(n.text for n in ls.NOTICES)), (2, ". ".join(n.text for n in ls.NOTICES if n.text.startswith(some)))]
    rows += [(i, "some plain text of the house by the road") for i in range(3, 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.labels for r in ls.op3_license_scan(spark, str(tmp_path)).collect()}
    assert got[1] == ",".join(sorted({n.label for n in ls.NOTICES})) and got[2] == "bsd,isc,mit,mpl,unlicense" and got[3] == ""


BODIES = {
    "mit": """* Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software")...
 * The above copyright notice and this permission notice shall be included in
 * all copies or substantial portions of the Software.""",
    "apache": """# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0""",
    "gpl": """// This program is free software; you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation; either version 2 of the License""",
    "bsd": """1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.""",
    "mpl": "/* This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. */",
    "zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.""",
}


def test_bodies_of_licences_without_their_names(spark, tmp_path):
    rows = [(i, f"some words before\n{body}\nand after") for i, body in enumerate(BODIES.values())] + [(99, "you may use this software in any way and modify it")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.labels for r in ls.op3_license_scan(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(BODIES))] == list(BODIES) and got[99] == ""
