import re

import numpy as np
import pytest
import xxhash

from repograph.llm.components import connected_components
from repograph.llm.gray_index import GrayIndex, forest, gray_rank
from repograph.llm.hashing import U64
from repograph.llm.simhash_dedup import fingerprints, near_duplicates, one_of_each, op8_simhash_gray
from repograph.llm.storage import Workspace


def brute_print(text, words=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, limit):
    component = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= limit and component[i] != component[j]:
                a, b = component[i], component[j]
                component = [b if c == a else c for c in component]
    least = {}
    for i, c in zip(ids, component):
        least[c] = min(least.get(c, i), i)
    return [least[c] for c in component]


def test_fingerprints():
    texts = ["", "a", "A b", "a b c", "one two\tthree four\x0bfive", "É é x y z " * 300, "q " * 1000, None]
    got = fingerprints([None if t is None else t.encode() for t in texts], 3)
    assert [int(x) for x in got] == [brute_print(t) for t in texts]


def test_gray_index_search():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 8, dtype=U64)
    codes = np.unique(np.concatenate([centre[rng.integers(0, 8, 700)] ^ (U64(1) << rng.integers(0, 64, 700).astype(U64)), rng.integers(0, 1 << 63, 500, dtype=U64)]))
    codes = codes[np.argsort(gray_rank(codes))]
    assert [int(g) for g in gray_rank(np.array([0, 1, 3, 2, 6], U64))] == [0, 1, 2, 3, 4]
    q, c = GrayIndex(codes).search(codes, 3)
    want = np.argwhere(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3)
    assert sorted(zip(q.tolist(), c.tolist())) == [tuple(x) for x in want.tolist()]
    node, root = forest(codes[q], codes[c])
    assert len(node) == len(set(node.tolist())) < len(codes) and not set(node.tolist()) & set(root.tolist())


@pytest.mark.parametrize("finish", [0, 20, 10**6])
def test_components_of_chains_stars_and_loops(spark, finish):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (None, 7), (200, 201), (201, 200)]
    work = Workspace(spark, "test")
    rows = connected_components(spark.createDataFrame(links, "a long, b long"), work, finish).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 130)), [200, 201]]
    assert connected_components(spark.createDataFrame([], "a long, b long"), work).count() == 0


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(1, 200, 30)]
    texts = base + base[:10] + [t + " tail" for t in base] + ["x " + t for t in base] + [None, "", " \n"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = near_duplicates(df, limit=4).collect()
    assert len(got) == len(rows)
    prints = [brute_print(t) for t in texts]
    want = dict(enumerate(brute_components(range(len(texts)), prints, 4)))
    assert {r.id: r.component for r in got} == want
    assert {r.id: r.fp % 2**64 for r in got} == dict(enumerate(prints))
    assert near_duplicates(df.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in op8_simhash_gray(spark, "/root/testdata/sf0.001").collect()}
    prints = [brute_print(r.text) for r in rows]
    assert {i: r.fingerprint for i, r in got.items()} == {r.doc_id: f"{p:016x}" for r, p in zip(rows, prints)}
    want = brute_components([r.doc_id for r in rows], prints, 2)
    assert {i: r.component_id for i, r in got.items()} == {r.doc_id: c for r, c in zip(rows, want)}


def test_one_of_each(spark):
    rows = [(3, "a b c d e f g", "x"), (1, "A b c d e f g", "y"), (1, "A b c d e f g", "y"), (None, "a b c d e f g", "z"), (None, "q r s t u v", "z"), (None, "q r s t u v", "z"), (7, None, "n"), (8, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = one_of_each(df, words=5, limit=3)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "A b c d e f g", "y"), (None, "q r s t u v", "z"), (7, None, "n")], key=str)
    assert one_of_each(df.limit(0), words=5, limit=3).count() == 0
