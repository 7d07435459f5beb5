"""Secret scans: fixed forms, and sliding-window entropy over candidate strings (operator 4).

Fixed forms (see FORMS) are leftmost non-overlapping matches of each kind that are long enough. Besides them, every run
of key characters is a candidate. Its characters give its class (hex, alphanumeric, base64); a window slides over it,
whose Shannon entropy is kept by adding the character that comes in and taking off the one that goes out, so a
candidate costs its length whatever the window. Windows over the class's threshold give a span of kind ``entropy``,
unless the allow-list suppresses them: a form that begins with ^ suppresses the candidate, any other one the windows that
overlap what it matches, or for a word the letters and digits around it. Spans are in code points, ends exclusive.

Defined cases: a null or empty text has no spans; equal rows get equal spans; an empty table gives an empty one; a text
or candidate of any length is seen whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repograph.llm.textmap import map_texts

#: Kind, pattern, the group whose length counts, its least length; in the order in which kinds at one place are listed.
FORMS = [
    ("assign", rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", rb"AKIA[A-Z0-9]+", 0, 18),
    ("hex", rb"[0-9a-f]+", 0, 16),
]
ENTROPY = "entropy"
KINDS = [*(f[0] for f in FORMS), ENTROPY]

WINDOW = 20
#: Bits a character over a window of WINDOW characters, by class.
THRESHOLDS = {"hex": 2.9, "alphanumeric": 3.6, "base64": 3.7}
#: What holds one of these is no secret: the candidate for a form of the whole, else the windows that overlap the place.
ALLOWED = (
    r"(?i)(?P<word>example|sample|dummy|placeholder|changeme|your[-_])",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"(.)\1{7,}",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[-0-9=_/+.]*$",
    r"^(sha(1|256|512)|md5)-",
)

_ASSIGN = re.compile(FORMS[0][1])
#: The two others need no dropping of short matches: a run that is long enough is the same match.
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
_CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+\Z")), ("alphanumeric", re.compile(r"[A-Za-z0-9]+\Z")))

SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]), False
)


def character_class(candidate: str) -> str:
    return next((name for name, pattern in _CLASSES if pattern.match(candidate)), "base64")


def window_entropies(text: str, window: int) -> list[float]:
    """Shannon entropy in bits of each ``window`` consecutive characters, from counts that are kept up to date."""
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: Counter[str] = Counter(text[:window])
    total = sum(term[c] for c in counts.values())
    out = [total]
    for gone, come in zip(text, text[window:]):
        if gone != come:
            c = counts[gone]
            total += term[c - 1] - term[c]
            counts[gone] = c - 1
            c = counts[come]
            total += term[c + 1] - term[c]
            counts[come] = c + 1
        out.append(total)
    size = min(window, len(text))
    return [math.log2(size) - t / size for t in out] if size else []


def suppressed(candidate: str, window: int, allowed: list[re.Pattern]) -> bytearray:
    """For each window, by its start, whether the allow-list suppresses it."""
    out = bytearray(max(1, len(candidate) - window + 1))
    for form in allowed:
        for m in form.finditer(candidate):
            if form.pattern.startswith(("^", "(?i)^")):
                return bytearray(b"\1") * len(out)
            start, end = m.span()
            if "word" in form.groupindex:
                while start and candidate[start - 1].isalnum():
                    start -= 1
                while end < len(candidate) and candidate[end].isalnum():
                    end += 1
            first = max(0, start - window + 1)
            last = min(end, len(out))
            out[first:last] = b"\1" * (last - first)
    return out


def entropy_spans(candidate: str, window: int, thresholds: dict[str, float], allowed: list[re.Pattern]) -> list[tuple[int, int]]:
    """Stretches of the candidate that are covered by windows over the threshold; none without a digit and a letter."""
    if not any(c.isdigit() for c in candidate) or not any(c.isalpha() for c in candidate):
        return []
    hidden = suppressed(candidate, window, allowed)
    limit = thresholds[character_class(candidate)]
    out: list[tuple[int, int]] = []
    for i, bits in enumerate(window_entropies(candidate, window)):
        if bits >= limit and not hidden[i]:
            if out and out[-1][1] >= i:
                out[-1] = (out[-1][0], i + window)
            else:
                out.append((i, i + window))
    # a stretch of plain letters is a word, not a secret
    return [(s, e) for s, e in out if any(c.isdigit() for c in candidate[s:e])]


def find(text: bytes, allowed: list[re.Pattern], window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) in code points, in order."""
    found: list[tuple[int, int, int]] = []
    if b"=" in text or b":" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= FORMS[0][3]]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for m in _CANDIDATE.finditer(text):
        base = m.start()
        found += [(base + s, 3, base + e) for s, e in entropy_spans(m[0].decode(), window, thresholds, allowed)]
    if found and not text.isascii():
        places = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        at = lambda i: int(places[i - 1]) if i else 0
        found = [(at(s), k, at(e)) for s, k, e in found]
    return sorted(found)


def scan(
    documents: DataFrame,
    *,
    keep: list[str],
    text: str = "text",
    window: int = WINDOW,
    thresholds: dict[str, float] | None = None,
    allow: tuple[str, ...] = ALLOWED,
    name: str = "spans",
) -> DataFrame:
    """The ``keep`` columns and an array of (kind, start, end) by start, then by kind as in KINDS."""
    limits = THRESHOLDS | (thresholds or {})
    allowed = [re.compile(a) for a in allow]

    def run(texts):
        return {name: [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t, allowed, window, limits)] if t else [] for t in texts]}

    return map_texts(documents, text, keep, T.StructType([T.StructField(name, SPANS, False)]), run)


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(told(F.filter("spans", lambda s: s["kind"] != ENTROPY)), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
