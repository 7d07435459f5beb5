from itertools import combinations

import numpy as np

import corpus_pipeline as cp
from tests.llm.test_simhash_dedup import brute_print


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + cp.SHINGLE]) for i in range(max(1, len(words) - cp.SHINGLE + 1))}


def like(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) >= cp.SIMILARITY


def families(rng):
    rows = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for _ in range(6):
            own = list(base)
            for at in rng.integers(0, 300, int(rng.integers(1, 12))):
                own[at] = "other"
            rows.append((len(rows), " ".join(own), "x"))
    return rows


def test_same_as_all_pairs(spark):
    """One of each group of pairs at a Jaccard similarity of 0.8 or within three bits, as if all had been compared."""
    rows = families(np.random.default_rng(4))
    rows += [(len(rows), rows[0][1], "x"), (len(rows) + 1, "a few", "x"), (len(rows) + 2, "", "x"), (len(rows) + 3, None, "x")]
    prints = [brute_print(t, cp.SHINGLE) for _, t, _ in rows]
    group = list(range(len(rows)))
    beyond = 0
    for i, j in combinations(range(len(rows)), 2):
        near = bin(prints[i] ^ prints[j]).count("1") <= cp.BITS
        similar = bool(rows[i][1] and rows[j][1]) and like(rows[i][1], rows[j][1])
        beyond += similar and not near
        if near or similar:
            group = [group[i] if g == group[j] else g for g in group]
    got = {r.doc_id for r in cp.dedup_documents(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()}
    assert got == {min(i for i, g in enumerate(group) if g == own) for own in set(group)}
    assert beyond > 20
