import hashlib
import sys

import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from repograph.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Library.from_file(PATH)
OWN = bpe.Tokenizer.from_bytes(open(PATH, "rb").read())

HARD = ["", " ", "a", "Hello, World's 42 it'll", "ΟΔΥΣΣΕΥΣ ΣΑΣ", "İstanbul", "été", "日本語 text", "<|endoftext|>", "a<|startoftext|>B<|endoftext", "x" * 300, "\x1c\x1d a\x85b᠎c", "aaaa aaaaaaa ababab", "😀😀 👩‍👩‍👧", "\u0000�"]


def check(texts):
    want = LIBRARY.encode_batch(texts, add_special_tokens=False)
    got = OWN.encode(texts)
    for t, w, g in zip(texts, want, got):
        assert g == w.ids, t[:50]
        assert OWN.decode(g) == LIBRARY.decode(w.ids, skip_special_tokens=False), t[:50]


def test_hard_cases():
    check(HARD)


def test_every_character():
    texts = [f":{chr(i)}B" for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    bad = [t for t, w, g in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False), OWN.encode(texts)) if w.ids != g]
    assert not bad, (len(bad), bad[:20])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(texts):
    check(texts)


def test_unordered_merges_are_refused():
    import json

    spec = json.load(open(PATH))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    with pytest.raises(ValueError):
        bpe.Tokenizer(spec)


def test_frames(spark):
    rows = [(1, "Hello hello", "q"), (1, "Hello hello", "q"), (2, None, None), (3, "", "r"), (None, "été " * 5000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = bpe.encode_and_decode(df, PATH, keep=["doc_id"]).collect()
    for r, (i, t, _) in zip(enc, rows):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r["ids"], r.decoded) == (i, ids, LIBRARY.decode(ids, skip_special_tokens=False))
    back = bpe.decode(bpe.encode(df, PATH, keep=["doc_id"]), PATH, keep=["doc_id"]).collect()
    assert [r.decoded for r in back] == [r.decoded for r in enc]
    assert bpe.encode(df.limit(0), PATH, keep=["doc_id"]).count() == 0


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in bpe.op6_bpe_pairs(spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        ids = LIBRARY.encode(r.text, add_special_tokens=False).ids
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
