import re

import duckdb
import numpy as np
import pytest

from repograph.llm.decontaminate import OP2_SQL, Index, decontaminate, find, op2_decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(text, items, window=10):
    doc = words(text)
    hit, found = set(), set()
    for item, t in items:
        w = words(t)
        if not w:
            continue
        n = min(window, len(w))
        for i in range(len(w) - n + 1):
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(doc), len(hit), sorted(found)


def sample(seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "of", "ünd", "x1", "Anno", "it's", "co-op", "日本", "b"]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, say(int(n))) for i, n in enumerate([0, 1, 2, 9, 10, 11, 14, 40])] + [(7, "one two")]
    docs = [say(int(n)) for n in rng.integers(0, 60, 40)] + [None, "", "...", items[6][1], f"q {items[7][1]}, r.\n" * 3]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_brute_force(seed):
    docs, items = sample(seed)
    items = [x for x in items if x[0] > 2]
    n, spans, found = find([None if d is None else d.encode() for d in docs], Index([(str(i), t.encode()) for i, t in items], 10, 5))
    for k, doc in enumerate(docs):
        assert (n[k], sum(e - s for s, e in spans[k]), sorted(found[k])) == brute(doc, items), k


def test_joins_give_the_same(spark):
    docs, items = sample()
    d = spark.createDataFrame([(i, t, 3) for i, t in enumerate(docs)], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    one = decontaminate(d, b, keep=["doc_id"]).orderBy("doc_id").collect()
    joined = decontaminate(d, b, keep=["doc_id"], block_bytes=60)
    assert one == joined.orderBy("doc_id").collect() and "Broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert decontaminate(d.limit(0), b, keep=["doc_id"], block_bytes=60).count() == 0
    assert [(r.n_words, r.n_hit, r["items"]) for r in one] == [brute(t, items) for t in docs]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontaminate(d.limit(0), b, keep=["doc_id"]).count() == 0
    assert decontaminate(d, b.limit(0), keep=["doc_id"]).first().n_hit == 0


def test_query(spark):
    got = {r.doc_id: r for r in op2_decontaminate(spark, "/root/testdata/sf0.001").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(0, len(w) - 9)):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        w, hit, found = words(r.text), set(), set()
        for k in range(len(w) - 9):
            if x := windows.get(tuple(w[k : k + 10])):
                hit.update(range(k, k + 10))
                found |= x
        assert (got[r.doc_id].n_words, got[r.doc_id].n_hit, got[r.doc_id].n_items) == (len(w), len(hit), len(found))
    assert any(r.contaminated for r in got.values())


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    assert sorted(map(tuple, op2_decontaminate(spark, sf).collect())) == sorted(con.execute(OP2_SQL).fetchall())
