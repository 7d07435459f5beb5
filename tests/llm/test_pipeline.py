import re
from itertools import combinations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash_dedup import brute_print

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """What goes into each stage and comes out of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (name, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / name)
        columns = docs.columns
        made = stage(spark, docs, SF)
        assert k == len(cp.STAGES) - 1 or made.columns == columns
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_language_keeps_documents_with_words(staged):
    before, after = staged[0], staged[1]
    left = {r.doc_id for r in before} - {r.doc_id for r in after}
    texts = {r.doc_id: r.text for r in before}
    assert all(len(re.findall(r"[a-z]+", texts[i].lower())) < 20 for i in left) and len(left) < 0.02 * len(before)


def test_lines_match_brute_force(staged):
    gone = brute_lines([(r.doc_id, r.text) for r in staged[1]])
    want = {r.doc_id: "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone.get((r.doc_id, r.text), ())) for r in staged[1]}
    assert {r.doc_id: r.text for r in staged[2]} == want
    assert all(r.n_chars == len(r.text) for r in staged[2])


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + cp.SHINGLE]) for k in range(max(1, len(words) - cp.SHINGLE + 1))} if words else set()


def alike(rows):
    """All pairs of rows within the bits, or with that Jaccard similarity of their shingles."""
    prints, sets = [brute_print(r.text, cp.SHINGLE) for r in rows], [shingles(r.text) for r in rows]
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if bin(prints[i] ^ prints[j]).count("1") <= cp.BITS or both and both >= cp.SIMILARITY * (len(sets[i]) + len(sets[j]) - both):
            yield i, j


def test_one_document_of_each_group(staged):
    rows = staged[2]
    group = list(range(len(rows)))
    for i, j in alike(rows):
        a, b = group[i], group[j]
        group = [a if g == b else g for g in group]
    least = {}
    for g, r in zip(group, rows):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert {r.doc_id for r in staged[3]} == set(least.values())
    assert not list(alike(staged[3]))


def test_leaks_go(spark, staged):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {}
    from tests.llm.test_decontaminate import words

    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    clean = set()
    for r in staged[3]:
        w = words(r.text)
        if not any(tuple(w[k : k + 10]) in windows for k in range(len(w))):
            clean.add(r.doc_id)
    assert {r.doc_id for r in staged[4]} == clean < {r.doc_id for r in staged[3]}
    assert brute_hits(staged[4][0].text, items)[1] == 0


def test_tokens(staged):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in staged[4]}
    assert {r.doc_id: r["ids"] for r in staged[5]} == {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    assert all(r.n_tokens == len(r["ids"]) for r in staged[5])


def test_run(spark, staged):
    got = cp.run(spark, SF)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted((r.doc_id, r.n_tokens) for r in staged[5])


ODD = [
    (1, "the house stands on the hill over there\nshared line of some words here", "en", "a", 10, "x"),
    (2, "the dog runs over the road to the house\nshared line of some words here", "en", "a", None, "x"),
    (2, "the dog runs over the road to the house\nshared line of some words here", "en", "a", None, "x"),
    (3, None, "en", None, 0, None),
    (4, "", None, None, 0, None),
    (5, "12 34 !?", None, "b", 8, None),
    (None, "das haus steht auf dem berg und der hund auch", "de", "b", 45, "y"),
    (6, "long " * 30000, None, "b", 150000, "z"),
]


@pytest.mark.parametrize("with_languages", [True, False])
def test_odd_documents_go_through_all_stages(spark, tmp_path, with_languages):
    """Nulls, repeats, empty and long texts, and columns whose names stages use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, ids string")
    df = df.selectExpr("*", "'c' AS fp", "1 AS n_words", "'s' AS spans", "2 AS line", "3 AS sum", "4 AS n_kept")
    if not with_languages:
        df = df.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", *[c for c in df.columns if c not in ("doc_id", "text", "lang")])
    spark.createDataFrame([(1, "not found anywhere in these texts")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, sizes = df, []
    for k, (name, stage) in enumerate(cp.STAGES):
        before = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == before
        sizes.append(sorted((r.doc_id for r in docs.collect()), key=str))
    assert sizes[0] == [1, 2, 2, 6, None] and sizes[1] == sizes[0]
    assert sizes[2] == [1, 2, 6, None] == sizes[4]


def test_empty_documents_go_through_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0
