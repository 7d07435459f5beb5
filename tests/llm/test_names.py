"""Columns of the rows that are named like a result: they get ``input_`` in front, and nothing else changes."""

import pytest

from repograph.llm import bpe, decontaminate, language_crf, license_scan, line_dedup, reshard, secrets, simhash_dedup
from repograph.llm.textmap import free_names

TEXTS = ["the house and the hill, token = abcdef0123456789", None, "", "released under the MIT License", "the house and the hill, token = abcdef0123456789"]


def frame(spark, names):
    rows = [(i, t, "en", *(f"{n}{i}" for n in names)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))


def model(docs):
    return language_crf.fit(docs)


OPERATORS = {
    "lines": (lambda d, keep: line_dedup.dedup_lines(d), ["n_lines", "n_kept", "lines", "id", "s1"], {"n_lines", "n_kept"}),
    "leaks": (lambda d, keep: decontaminate.decontaminate(d, d.selectExpr("doc_id item_id", "text"), keep=keep), ["n_words", "n_hit", "spans", "items"], {"n_words", "n_hit", "spans", "items"}),
    "many leaks": (
        lambda d, keep: decontaminate.decontaminate(d, d.selectExpr("doc_id item_id", "text"), keep=keep, block_bytes=1), ["n_words", "n_hit", "h", "row", "items"], {"n_words", "n_hit", "items"},
    ),
    "licences": (lambda d, keep: license_scan.scan(d, keep=keep), ["n_words", "places", "matches", "score", "words", "votes"], {"n_words", "places", "matches", "score"}),
    "secrets": (lambda d, keep: secrets.scan(d, keep=keep), ["spans", "SPANS2"], {"spans"}),
    "language": (lambda d, keep: language_crf.identify(d, model(d), keep=keep), ["lang_pred", "score"], {"lang_pred", "score"}),
    "encode": (lambda d, keep: bpe.encode(d, bpe.default_path(), keep=keep), ["ids", "decoded"], {"ids"}),
    "decode": (lambda d, keep: bpe.decode(bpe.encode(d, bpe.default_path(), keep=keep), bpe.default_path(), keep=keep), ["decoded"], {"decoded"}),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, name):
    run, names, results = OPERATORS[name]
    docs = frame(spark, names)
    keep = ["doc_id", *names]
    out = run(docs, keep)
    plain = run(frame(spark, ["plain"]), ["doc_id", "plain"])
    mine = {n: f"input_{n}" if n in results else n for n in names}
    assert set(mine.values()) | results <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    got, want = ({r.doc_id: r for r in df.collect()} for df in (out, plain))
    assert set(got) == set(range(5)) == set(want)
    for i, r in got.items():
        assert all(r[m] == f"{n}{i}" for n, m in mine.items())
        assert all(r[x] == want[i][x] for x in results)


def test_operators_with_columns_of_their_own(spark):
    """These return no column of the rows but the id."""
    docs = frame(spark, ["id", "fp", "component", "group", "size", "old", "class", "part", "salt", "unit", "number", "slot", "shard"])
    assert sorted(r.id for r in reshard.reshard(docs, shards=3).collect()) == list(range(5))
    found = {r.id: r.component for r in simhash_dedup.near_duplicates(docs).collect()}
    assert found == {0: 0, 1: 1, 2: 1, 3: 3, 4: 0}
    assert sorted(r.doc_id for r in simhash_dedup.one_of_each(docs, words=5, limit=3, similarity=0.8).collect()) == [0, 1, 3]


def test_free_names():
    assert free_names(["a", "B", "input_b", "c"], ["A", "b"]) == ["input_a", "input_input_B", "input_b", "c"]
