import itertools
import zlib

import numpy as np

from repograph.llm import language_crf as crf

ROWS = [("en", b"the house and the dog are on the road with them"), ("de", "das haus und der hund sind auf der straße mit ihnen".encode()), ("fr", "la maison et le chien sont sur la route avec eux été".encode())] * 30


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 4, 2])
    score, transition, start = rng.normal(size=(10, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    marginal, expected, log_z, _ = crf.forward_backward(score, lengths, transition, start)
    want, pairs, at = np.zeros((10, 3)), np.zeros((3, 3)), 0
    for n in lengths:
        total, own, steps = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(start[path[0]] + sum(score[at + i, y] for i, y in enumerate(path)) + sum(transition[x, y] for x, y in zip(path, path[1:])))
            total += p
            for i, y in enumerate(path):
                own[i, y] += p
            for x, y in zip(path, path[1:]):
                steps[x, y] += p
        want[at : at + n] = own / total
        pairs += steps / total
        assert np.isclose(log_z[at : at + n].sum(), np.log(total))
        at += n
    assert np.allclose(marginal, want) and np.allclose(expected, pairs)


def test_code_switched_words():
    model = crf.train(ROWS, sequences=300, rounds=40)
    marginal, count = model.words([b"the house and the dog das haus und der hund", None, b"123 !"])
    labels = [model.languages[i] for i in marginal.argmax(axis=1)]
    assert count.tolist() == [10, 0, 0] and labels == ["en"] * 5 + ["de"] * 5
    assert model.transition[0, 0] > model.transition[0, 1]


def test_scores_by_brute_force():
    rng = np.random.default_rng(4)
    weights = rng.normal(size=(crf.FEATURES, 2)).astype(np.float32)
    buffer = "ab été\nc  abcdefg".encode()
    whole = crf.scores(*crf.word_bounds(buffer), weights)
    for word, got in zip(buffer.split(), whole):
        assert np.allclose(crf.scores(*crf.word_bounds(word), weights)[0], got, atol=1e-4)


def test_cases(spark):
    rows = [(i, t.decode(), lang, "x") for i, (lang, t) in enumerate(ROWS)] + [(900, None, None, "x"), (901, "12 + 3", "en", "x"), (902, "", None, "x"), (None, "the dog", None, "x"), (903, "the dog " * 20000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = crf.fit(df)
    assert model.languages == ["de", "en", "fr"]
    got = crf.identify(df, model, keep=["doc_id"]).collect()
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902)) and by[None].lang_pred == "en" and by[903].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)
    assert crf.identify(df.limit(0), model, keep=["doc_id"]).count() == 0
    blank = crf.identify(df, crf.fit(df.where("doc_id > 899")), keep=["doc_id"]).collect()
    assert {r.lang_pred for r in blank} <= {"und", "en"}
    words = crf.word_languages(df.where("doc_id = 0"), model, keep=["doc_id"]).first().languages
    assert words == ["en"] * 11


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = crf.op5_language_crf(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held)
    assert right > 0.97, right
