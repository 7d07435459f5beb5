"""Language identification of words in code-switched text by a linear-chain conditional random field (operator 5).

A word's score for each language adds up learned weights of its affixes, its byte n-grams and, where it is in the
learned lexicon, of itself; learned transitions tie neighbouring words. Each line of a text is a chain; forward-backward
gives every word's distribution, and a text's language is the one with the highest mean. All lines of a piece of a
partition are worked through together, longest first, so a step costs what the lines still running need.

Training: documents that are not held out (crc32 of the id as text, modulo 4, is not 2) and have a language. From each
language at most SAMPLE_DOCUMENTS whole documents are drawn by a hash of the id; stretches of them are spliced into
SEQUENCES chains that switch language now and then, so that every word's label is known and transitions are learned.
Those bounds hold at any size of the input; everything else covers all rows.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without any labelled document all are
``und``; rows with a null id are not held out and not learned from; equal texts get equal answers; an empty table gives an
empty one; texts are seen whole.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repograph.llm.hashing import U64, mix, word_bounds, word_hashes
from repograph.llm.textmap import map_texts

UNKNOWN = "und"
SAMPLE_DOCUMENTS = 250
SEQUENCES = 3000
ROUNDS = 60
LEXICON_COUNT = 3
HELD_OUT = (4, 2)

#: Of a word: lower-case ASCII letters and all other bytes from 0x80 on.
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 or b == 0x0A else 0x20 for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")

#: Weight tables by kind of feature: bits of the place in it.
AFFIX_BITS, BIGRAM_BITS, TRIGRAM_BITS, LEXICON_BITS = 16, 16, 17, 18
AFFIXES = (1, 2, 3, 4)
_OFFSETS = np.cumsum([0, 1 << AFFIX_BITS, 1 << BIGRAM_BITS, 1 << TRIGRAM_BITS, 1 << LEXICON_BITS])
FEATURES = int(_OFFSETS[-1])


def clean(text: bytes) -> bytes:
    low = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return low.translate(_LETTERS)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def word_features(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """One feature number for each word, of each kind that a word has one of: affixes of every length, the word itself."""
    length = ends - starts
    out = []
    for n in AFFIXES:
        for side in (0, 1):
            place = np.minimum(starts, len(a) - n) if side == 0 else np.maximum(ends - n, 0)
            code = np.full(len(starts), 2 * n + side, U64)
            for i in range(n):
                code = (code << U64(8)) | a[np.clip(place + i, 0, len(a) - 1)].astype(U64)
            number = (mix(code) >> U64(64 - AFFIX_BITS)).astype(np.int64)
            out.append(np.where(length >= n, number, -1))
    out.append(_OFFSETS[3] + (word_hashes(a, starts, ends) >> U64(64 - LEXICON_BITS)).astype(np.int64))
    return out


def gram_features(a: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(n, feature number of the n-gram that begins at each byte), for the kinds that a word has several of."""
    wide = a.astype(np.int64)
    pair = (wide[:-1] << 8) | wide[1:]
    triple = ((pair[:-1] << 8) | wide[2:]).astype(U64)
    return [(2, _OFFSETS[1] + pair), (3, _OFFSETS[2] + (mix(triple) >> U64(64 - TRIGRAM_BITS)).astype(np.int64))]


def scores(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of the weights of each word's features, by language."""
    out = np.zeros((len(starts), weights.shape[1]), np.float32)
    if not len(starts):
        return out
    for number in word_features(a, starts, ends):
        out += np.where((number >= 0)[:, None], weights[number], np.float32(0))
    inside = a > 0x20
    for n, number in gram_features(a):
        whole = inside[: len(number)].copy()
        for i in range(1, n):
            whole &= inside[i : i + len(number)]
        at = np.flatnonzero(whole)  # n-grams within a word; a word of length k has k - n + 1
        count = np.maximum(ends - starts - n + 1, 0)
        has = np.flatnonzero(count)
        if len(has):
            first = np.cumsum(count[has]) - count[has]
            out[has] += np.add.reduceat(weights[number[at]], first, axis=0)
    return out


def forward_backward(score: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray):
    """Distributions of the labels of all words of chains that lie one after the other; the log-likelihood's parts.

    Returns the marginals, the expected transitions, the logarithm of the partition sums, and the first words' places.
    """
    n, labels = score.shape
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max()) if len(lengths) else 0
    first = (np.cumsum(lengths) - lengths)[order]
    ordered = lengths[order]
    active = np.searchsorted(-ordered, -np.arange(longest), "left")  # chains longer than t
    top = score.max(axis=1, keepdims=True)
    emit = np.exp(score - top, dtype=np.float64)
    step = np.exp(transition.astype(np.float64))
    alpha, beta = np.empty((n, labels)), np.empty((n, labels))
    scale = np.empty(n)
    for t in range(longest):
        at = first[: active[t]] + t
        value = np.exp(start.astype(np.float64))[None, :] * emit[at] if t == 0 else (alpha[at - 1] @ step) * emit[at]
        total = value.sum(axis=1)
        alpha[at], scale[at] = value / total[:, None], total
    expected = np.zeros((labels, labels))
    for t in range(longest - 1, -1, -1):
        now = active[t]
        at = first[:now] + t
        more = active[t + 1] if t + 1 < longest else 0
        beta[at[more:]] = 1.0
        if more:
            after = at[:more] + 1
            coming = emit[after] * beta[after] / scale[after][:, None]
            beta[at[:more]] = coming @ step.T
            expected += alpha[at[:more]].T @ coming
    marginal = alpha * beta
    marginal /= marginal.sum(axis=1, keepdims=True)
    return marginal, expected * step, np.log(scale) + top[:, 0], first


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, transition: np.ndarray, start: np.ndarray):
        self.languages, self.weights, self.transition, self.start = languages, weights, transition, start

    def words(self, texts: list[bytes | None]):
        """Distributions of all words of the texts, one after the other; the number of words of each text."""
        cleaned = [clean(t) if has_letter(t) else b"" for t in texts]
        buffer = b"\n".join(cleaned)
        a, starts, ends = word_bounds(buffer)
        sizes = np.fromiter(map(len, cleaned), np.int64, len(cleaned)) + 1
        bounds = np.append(np.searchsorted(starts, np.cumsum(sizes) - sizes), len(starts))
        lines = np.searchsorted(starts, np.append(np.flatnonzero(a == 0x0A), len(a)))
        lengths = np.diff(lines, prepend=0)
        score = scores(a, starts, ends, self.weights)
        if not len(score):
            return np.zeros((0, len(self.languages))), np.diff(bounds)
        marginal, *_ = forward_backward(score, lengths[lengths > 0], self.transition, self.start)
        return marginal, np.diff(bounds)

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        marginal, count = self.words(texts)
        mean = np.zeros((len(texts), len(self.languages)))
        has = np.flatnonzero(count)
        if len(has):
            first = np.cumsum(count[has]) - count[has]
            mean[has] = np.add.reduceat(marginal, first, axis=0) / count[has][:, None]
        best = mean.argmax(axis=1)
        languages = [self.languages[b] if c else UNKNOWN for b, c in zip(best.tolist(), count.tolist())]
        return languages, np.clip(mean.max(axis=1, initial=0.0), 0.0, 1.0).tolist()


def _chains(rows: list[tuple[str, bytes]], languages: list[str], sequences: int, seed: int):
    """Spliced chains: the words' text as one buffer, their labels, the chains' lengths."""
    rng = np.random.default_rng(seed)
    by: list[list[list[bytes]]] = [[] for _ in languages]
    for language, text in rows:
        if words := clean(text).split():
            by[languages.index(language)].append(words)
    present = [k for k, docs in enumerate(by) if docs]
    words, labels, lengths = [], [], []
    for s in range(sequences if present else 0):
        k = present[s % len(present)]
        size = 0
        for _ in range(int(rng.integers(1, 4))):
            docs = by[k]
            doc = docs[int(rng.integers(len(docs)))]
            n = min(len(doc), int(rng.integers(3, 45)))
            at = int(rng.integers(len(doc) - n + 1))
            words += doc[at : at + n]
            labels += [k] * n
            size += n
            if rng.random() < 0.3:
                k = present[int(rng.integers(len(present)))]
        lengths.append(size)
    return words, np.array(labels, np.int64), np.array(lengths, np.int64)


def train(rows: list[tuple[str, bytes]], *, sequences: int = SEQUENCES, rounds: int = ROUNDS, seed: int = 7, rate: float = 0.15, decay: float = 1e-5) -> Model:
    """Maximum conditional likelihood by gradient steps of adapted size."""
    languages = sorted({language for language, _ in rows})
    labels_n = len(languages)
    words, label, lengths = _chains(rows, languages, sequences, seed)
    if not words:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    known, word = np.unique(np.array(words, object).astype(bytes), return_inverse=True)
    # features of each known word: (word, feature) pairs
    buffer = b" ".join(known.tolist())
    a, starts, ends = word_bounds(buffer)
    of, feature = [], []
    for number in word_features(a, starts, ends):
        at = np.flatnonzero(number >= 0)
        of.append(at)
        feature.append(number[at])
    inside = a > 0x20
    owner = np.searchsorted(starts, np.arange(len(a)), "right") - 1
    for n, number in gram_features(a):
        whole = inside[: len(number)].copy()
        for i in range(1, n):
            whole &= inside[i : i + len(number)]
        at = np.flatnonzero(whole)
        of.append(owner[at])
        feature.append(number[at])
    times = np.bincount(word, minlength=len(known))
    rare = np.arange(len(known))[times < LEXICON_COUNT]
    k = 2 * len(AFFIXES)  # the lexicon holds words that came often enough
    stay = ~np.isin(of[k], rare)
    of[k], feature[k] = of[k][stay], feature[k][stay]
    of, feature = np.concatenate(of), np.concatenate(feature)
    used, place = np.unique(feature, return_inverse=True)

    weights = np.zeros((len(used), labels_n))
    transition, start = np.zeros((labels_n, labels_n)), np.zeros(labels_n)
    first = np.cumsum(lengths) - lengths
    observed = np.zeros((labels_n, labels_n))
    inner = np.ones(len(label), bool)
    inner[first] = False
    np.add.at(observed, (label[np.flatnonzero(inner) - 1], label[inner]), 1)
    truth = np.zeros((len(label), labels_n))
    truth[np.arange(len(label)), label] = 1
    parameters = [weights, transition, start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    for turn in range(1, rounds + 1):
        by_word = np.stack([np.bincount(of, weights=weights[place, j], minlength=len(known)) for j in range(labels_n)], axis=1)
        marginal, expected, _, _ = forward_backward(by_word[word], lengths, transition, start)
        off = truth - marginal
        of_word = np.stack([np.bincount(word, weights=off[:, j], minlength=len(known)) for j in range(labels_n)], axis=1)
        gradients = [
            np.stack([np.bincount(place, weights=of_word[of, j], minlength=len(used)) for j in range(labels_n)], axis=1) / len(label),
            (observed - expected) / len(label),
            off[first].sum(axis=0) / len(label),
        ]
        for p, g, (m, v) in zip(parameters, gradients, moments):
            g -= decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-9)
    table = np.zeros((FEATURES, labels_n), np.float32)
    table[used] = weights
    return Model(languages, table, transition, start)


def _is_held_out(id_col: str):
    modulus, remainder = HELD_OUT
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def fit(documents: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCUMENTS) -> Model:
    """The model of the documents that are not held out; ``sample`` bounds how many of each language are read by the driver."""
    key = F.xxhash64(F.col(f"`{id_col}`"))
    rows = documents.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), key.alias("key"), _is_held_out(id_col).alias("out")
    ).where("id IS NOT NULL AND lang IS NOT NULL AND NOT out")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return train([])
    # each language's share of the hashes, so that about ``sample`` of its documents are drawn
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1 << 20, max(1, (sample << 20) // n)))).otherwise(share)
    drawn = rows.where("text IS NOT NULL").where(F.pmod("key", F.lit(1 << 20)) < share)
    got = drawn.orderBy("key", "id", "text").limit(2 * sample * len(counts)).select("lang", "text").collect()
    return train(sorted((r["lang"], r["text"].encode()) for r in got))


RESULT = T.StructType([T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])


def identify(documents: DataFrame, model: Model, *, keep: list[str], text: str = "text", prefix: str = "") -> DataFrame:
    """The ``keep`` columns with the language and its score."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # a table of fixed size for each language
    added = T.StructType([T.StructField(prefix + f.name, f.dataType, f.nullable) for f in RESULT.fields])

    def run(texts):
        languages, score = held.value.predict(texts)
        return {prefix + "lang_pred": languages, prefix + "score": score}

    return map_texts(documents, text, keep, added, run)


def word_languages(documents: DataFrame, model: Model, *, keep: list[str], text: str = "text", name: str = "languages") -> DataFrame:
    """The ``keep`` columns and each word's most probable language, in order: spans of code-switched text."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    added = T.StructType([T.StructField(name, T.ArrayType(T.StringType(), False), False)])

    def run(texts):
        model = held.value
        marginal, count = model.words(texts)
        labels = np.array(model.languages, object)[marginal.argmax(axis=1)] if len(marginal) else np.zeros(0, object)
        ends = np.cumsum(count)
        return {name: [labels[e - c : e].tolist() for e, c in zip(ends.tolist(), count.tolist())]}

    return map_texts(documents, text, keep, added, run)


def op5_language_crf(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = documents.withColumn("held_out", _is_held_out("doc_id"))
    return identify(rows, fit(documents), keep=["doc_id", "held_out"])
