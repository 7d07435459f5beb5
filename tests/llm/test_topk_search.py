import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from repograph.llm import topk_search as tk


def brute(rows, picked, k=5, scale=256):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(scale * float(x)) for x in v]
            if sum(x * x for x in w) < 2**62:
                good.append((i, w))
    query = {}
    for i, w in good:
        if picked(i):
            query[i] = min(query.get(i, w), w, key=lambda w: np.array(w, "<i4").tobytes())
    out = []
    for i, w in query.items():
        own = sorted((-sum(a * b for a, b in zip(w, x)), j) for j, x in good if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(own)]
    return sorted(out)


def run(spark, rows, condition="id % 5 = 0", **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    return sorted(tuple(r) for r in tk.top_k(df, F.expr(condition), **more).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, 8))
    x = centre[rng.integers(0, 6, 600)] + 0.1 * rng.normal(size=(600, 8))
    x[100:200] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1005, [1.0, None] + [0.0] * 6), (1010, [math.nan] * 8), (1015, [math.inf] * 8), (1020, [1.0, 2.0]), (None, [0.5] * 8)]
    rows += [(1025, [1e300] * 8), (1030, [0.0] * 8), (1030, [1.0] * 8), (1035, [])]
    want = brute(rows, lambda i: i % 5 == 0)
    assert run(spark, rows, annulus=16) == want
    assert run(spark, rows, pivots=3, sample=20, packet=7, annulus=50) == want


def test_few_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert run(spark, [(0, []), (1, [])]) == [(0, 1, 1, 0)]


def test_large_components_stay_exact(spark):
    rows = [(i, [(i * 7919 % 1000) * 100003.0 + 0.5, float(-i)]) for i in range(60)]
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_annuli_are_left_out():
    """Bounds leave out many annuli, and none that holds a vector of the score."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(200, 220, (400, 8)), rng.integers(-220, -200, (400, 8))])
    most = int((x * x).sum(axis=1).max())
    centres = tk.choose_pivots(tk.raised(x, most), 2)
    d = tk.distances(tk.raised(x, most), centres)
    parts = []
    for p in range(2):
        own = np.flatnonzero(d.argmin(axis=1) == p)
        own = own[np.argsort(d[own, p])]
        parts += [(p, own[s : s + 50]) for s in range(0, len(own), 50)]
    pivot, least, far = (np.array(v) for v in zip(*((p, d[i[0], p], d[i[-1], p]) for p, i in parts)))
    q = x[::40]
    scores = q @ x.T
    fifth = np.sort(scores, axis=1)[:, -5]
    able = tk.reaches(tk.bounds(tk.distances(tk._flat(q), centres), pivot, least, far), q, fifth, most)
    assert able.mean() <= 0.5
    for j, (_, own) in enumerate(parts):
        assert able[(scores[:, own] >= fifth[:, None]).any(axis=1), j].all()


def test_one_plan_for_any_number_of_queries(spark):
    """Two searches through the index, however many packets of queries there are, and a hot shell of equal vectors."""
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(i, [float(i % 7), float(i % 11)]) for i in range(300, 500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plans = [tk.top_k(df, F.expr("id % 2 = 0"), packet=n) for n in (3, 500)]
    assert [p._jdf.queryExecution().logical().toString().count("MapInArrow") for p in plans] == [3, 3]
    assert sorted(map(tuple, plans[0].collect())) == sorted(map(tuple, plans[1].collect())) == brute(rows, lambda i: i % 2 == 0)


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in tk.op10_topk_pivots(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(tk.OP10_SQL).fetchall())
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got == brute(rows, lambda i: i % 50 == 0)
