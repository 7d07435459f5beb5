"""BPE encoding and decoding with a public vocabulary, by a pair occurrence index (operator 6).

The new words of a piece of a partition are laid out as one line of symbols. Every adjacent pair that has a merge is
mapped to all its places in that line; the active ranks are taken in ascending order, each merging all places of its
pair, and the pairs that arise to the left and right join the lists of their own ranks. This gives what merging each
word by itself gives, as a merge's result only takes part in merges of higher rank; a vocabulary for which that does
not hold is refused. Known words are looked up; what is remembered is bounded by MEMO words.

Defined cases: a null or empty text has no ids, and decodes to the empty text; special tokens that stand in a text are
their ids, as in the library; bytes without a symbol are left out; repeated rows get equal rows; an empty table gives an
empty one; long texts are seen whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from repograph.llm.textmap import free_names, map_texts, prepare, tidy

#: A worker remembers the ids of so many words.
MEMO = 250_000
#: The pair index is made for pieces of about so many bytes: larger ones share more words.
INDEX_BYTES = 3 << 20
_SPACE = r"\t-\r \x85\xa0  -     　"
#: ASCII and the letters of the Latin-1 and Latin Extended-A blocks: texts of these are in NFC, lower-case to the same
#: and a combining dot, and hold no other letters or numbers; the white space among them is ASCII.
_PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ſ]*\\Z")
_PLAIN_LETTERS = "a-zÀ-ÖØ-öø-ſ"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


# The Unicode version of the tokenizers library is 16.0 in its patterns and 17.0 in its lower case; Python's
# tables are older and the pattern library's newer. Letters and numbers that 16.0 added to 15.1:
ADDED_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7D2 A7D4 A7DA-A7DC 105C0-105F3 10D40-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 "
    "113B7 113D1 113D3 116D0-116E3 11BC0-11BE0 11BF0-11BF9 13460-143FA 16100-1611D 16130-16139 16D40-16D6C 16D70-16D79 18CFF "
    "1CCF0-1CCF9 1E5D0-1E5ED 1E5F0-1E5FA"
)
# Capital letters that 16.0 and 17.0 added or gave a small one, as first capital, first small letter, number.
ADDED_CAPITALS = "1C89 1C8A 1, A7CB 264 1, A7CC A7CD 1, A7CE A7CF 1, A7D2 A7D3 1, A7D4 A7D5 1, A7DA A7DB 1, A7DC 19B 1, 10D50 10D70 22, 16EA0 16EBB 25"


def added_letters() -> set[int]:
    spans = [[int(x, 16) for x in span.split("-")] for span in ADDED_LETTERS.split()]
    return {c for span in spans for c in range(span[0], span[-1] + 1)}


def added_lower_case() -> dict[int, int]:
    rows = [row.split() for row in ADDED_CAPITALS.split(",")]
    return {int(a, 16) + i: int(b, 16) + i for a, b, n in rows for i in range(int(n))}


def newer_characters() -> str:
    """Ranges of a set: letters and numbers that the pattern library knows, but not Unicode 16.0."""
    ranges: list[list[int]] = []
    known = added_letters()
    unknown = "".join(chr(i) for i in range(0x110000) if i not in known and unicodedata.category(chr(i)) == "Cn")
    for c in map(ord, regex.findall(r"\p{L}|\p{N}", unknown)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Tokenizer:
    """Of a tokenizers file that lower-cases, splits by a pattern and merges bytes with a mark at word ends."""

    def __init__(self, spec: dict):
        model = spec["model"]
        steps = spec["normalizer"]["normalizers"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        wanted = (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
            and (split["type"], split["behavior"], split["invert"]) == ("Split", "Removed", True)
            and (level["type"], level["add_prefix_space"], level["use_regex"]) == ("ByteLevel", False, False)
            and model["type"] == "BPE"
            and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and not spec["post_processor"]
            and not spec["decoder"]
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        )
        if not wanted:
            raise ValueError("a tokenizer of another kind")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        texts = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, texts)) + ")") if texts else None
        pattern = split["pattern"]["Regex"].replace(r"\s", _SPACE)
        self.word_pattern = regex.compile(pattern)
        # the same for texts of plain characters, with the standard library's faster patterns
        plain = pattern.replace(r"[\p{L}]", rf"[{_PLAIN_LETTERS}]").replace(r"[\p{N}]", "[0-9]")
        plain = plain.replace(r"\p{L}", _PLAIN_LETTERS).replace(r"\p{N}", "0-9")
        self.plain_pattern = None if "\\p" in plain else re.compile(plain)
        newer = newer_characters()
        self.lower = added_lower_case()
        self.rare = regex.compile(f"[{newer}{''.join(f'\\U{c:08x}' for c in self.lower)}]")
        for kind in (r"\p{L}", r"\p{N}") if newer else ():
            pattern = pattern.replace(kind, f"[{kind}--[{newer}]]")
        self.exact_pattern = regex.compile(pattern, regex.V1)
        suffix = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        # bytes within a word, then those at its end
        self.first_ids = np.array([self.vocabulary.get(s, -1) for s in [*symbols, *(s + suffix for s in symbols)]], np.int64)
        self.missing = self.first_ids < 0
        self.pairs: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        made: dict[int, int] = {}
        for rank, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]):
            a, b, new = self.vocabulary[a], self.vocabulary[b], self.vocabulary[a + b]
            made.setdefault(new, rank)
            self.pairs[a << 20 | b] = rank
            self.merges.append((a, b, new))
        if any(made.get(x, -1) >= rank for rank, merge in enumerate(self.merges) for x in merge[:2]):
            raise ValueError("a merge's result takes part in a merge of lower rank")
        self.first_ranks = np.array([[self.pairs.get(a << 20 | b, -1) for b in self.first_ids.tolist()] for a in self.first_ids[:256].tolist()], np.int64)
        self.first_ranks = np.concatenate([self.first_ranks, np.full((256, 512), -1)])
        names = {i: s for s, i in (self.vocabulary | self.special).items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.numbers = [b"%d" % i for i in range(len(self.names))]
        self.memo: dict[str, list[int]] = {}

    @classmethod
    def from_bytes(cls, content: bytes) -> Tokenizer:
        return cls(json.loads(content))

    def words(self, text: str) -> list[str]:
        """The pieces that are merged each by itself, of a text without special tokens."""
        if self.plain_pattern and _PLAIN.match(text):
            return self.plain_pattern.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character by itself: no final sigma
        if self.rare.search(text):
            return self.exact_pattern.findall(text.lower().translate(self.lower))
        return self.word_pattern.findall(text.lower())

    def merged(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        data = [w.encode() for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        line = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
        ends = np.cumsum(size) - 1
        line[ends] += 256  # the last byte of a word is a symbol of its own
        owner = np.repeat(np.arange(len(data)), size)
        if self.missing[line].any():
            there = ~self.missing[line]
            line, owner = line[there], owner[there]
        n = len(line)
        joined = np.zeros(n + 1, bool)  # whether a place and the one before are of one word
        joined[1:n] = owner[1:] == owner[:-1]
        rank = np.where(joined[1:n], self.first_ranks[line[:-1], line[1:]], -1) if n else np.zeros(0, np.int64)
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        active, starts = np.unique(rank[at], return_index=True)
        places: dict[int, list[int]] = {r: x.tolist() for r, x in zip(active.tolist(), np.split(at, starts[1:]))}
        active = active.tolist()  # sorted: a heap
        symbol = self.first_ids[line].tolist()
        here = np.arange(n)
        after = np.where(joined[1:], here + 1, -1).tolist()
        before = np.where(joined[:n], here - 1, -1).tolist()
        pairs, merges = self.pairs, self.merges
        while active:
            rank = heapq.heappop(active)
            a, b, new = merges[rank]
            for p in sorted(places.pop(rank)):
                q = after[p]
                if symbol[p] != a or q < 0 or symbol[q] != b:
                    continue
                symbol[p], symbol[q] = new, -1
                after[p] = r = after[q]
                if r >= 0:
                    before[r] = p
                    other = pairs.get(new << 20 | symbol[r])
                    if other is not None:
                        if other in places:
                            places[other].append(p)
                        else:
                            places[other] = [p]
                            heapq.heappush(active, other)
                r = before[p]
                if r >= 0:
                    other = pairs.get(symbol[r] << 20 | new)
                    if other is not None:
                        if other in places:
                            places[other].append(r)
                        else:
                            places[other] = [r]
                            heapq.heappush(active, other)
        symbol = np.array(symbol, np.int64)
        left = symbol >= 0
        ids = symbol[left].tolist()
        cuts = [0, *np.cumsum(np.bincount(owner[left], minlength=len(data))).tolist()]
        return [ids[s:e] for s, e in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        parts: list[list[str | int]] = []
        for text in texts:
            if not text:
                parts.append([])
            elif self.special_pattern and self.special_pattern.search(text):
                own: list[str | int] = []
                for part in self.special_pattern.split(text):
                    own += [self.special[part]] if part in self.special else self.words(part)
                parts.append(own)
            else:
                parts.append(self.words(text))
        new = {w for own in parts for w in own}.difference(self.memo)
        fresh = [w for w in new if isinstance(w, str)]
        memo = self.memo
        memo |= dict(zip(fresh, self.merged(fresh)))
        memo |= {w: [w] for w in new if not isinstance(w, str)}
        out = []
        for own in parts:
            ids: list[int] = []
            for w in own:
                ids += memo[w]
            out.append(ids)
        if len(memo) > MEMO:
            memo.clear()
        return out

    def decode(self, ids: list[int]) -> str:
        """The ids' symbols, special tokens too, with spaces between, as a tokenizer without a decoder gives them."""
        names = self.names
        return b" ".join([names[i] for i in ids]).decode()


_held: dict[int, Tokenizer] = {}


def _tokenizer(content) -> Tokenizer:
    """One for each worker and vocabulary."""
    key = hash(content.value)
    if key not in _held:
        _held.clear()
        _held[key] = Tokenizer.from_bytes(content.value)
    return _held[key]


def vocabulary(spark, path: str):
    """The file, read by the driver and sent to the tasks: a few MB, whatever the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False)])
DIGESTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids_sha256", T.StringType(), False),
        T.StructField("decoded_sha256", T.StringType(), False),
    ]
)


def _texts(data: list[bytes | None]) -> list[str | None]:
    return [None if d is None else d.decode("utf-8", "replace") for d in data]


def encode_and_decode(documents: DataFrame, path: str, *, keep: list[str], text: str = "text", prefix: str = "") -> DataFrame:
    """The ``keep`` columns, the ids of each whole text, and their decoded text."""
    content = vocabulary(documents.sparkSession, path)
    added = T.StructType([T.StructField(prefix + f.name, f.dataType, f.nullable) for f in ENCODED.fields])

    def run(data):
        tokenizer = _tokenizer(content)
        ids = tokenizer.encode(_texts(data))
        return {prefix + "ids": ids, prefix + "decoded": [tokenizer.decode(x) for x in ids]}

    return map_texts(documents, text, keep, added, run, INDEX_BYTES)


def encode(documents: DataFrame, path: str, *, keep: list[str], text: str = "text", name: str = "ids") -> DataFrame:
    """The ``keep`` columns and the ids of each whole text."""
    content = vocabulary(documents.sparkSession, path)
    added = T.StructType([T.StructField(name, ENCODED["ids"].dataType, False)])
    return map_texts(documents, text, keep, added, lambda data: {name: _tokenizer(content).encode(_texts(data))}, INDEX_BYTES)


def decode(encoded: DataFrame, path: str, *, keep: list[str], ids: str = "ids") -> DataFrame:
    """The ``keep`` columns and the decoded text of an array of ids; null as the empty text."""
    prepare(encoded.sparkSession)
    content = vocabulary(encoded.sparkSession, path)
    names = free_names(keep, ["decoded"])
    schema = T.StructType([*(T.StructField(n, encoded.schema[c].dataType) for n, c in zip(names, keep)), ENCODED["decoded"]])

    def run(batches):
        for batch in batches:
            texts = [_tokenizer(content).decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.select(*dict.fromkeys([*keep, ids])).mapInArrow(tidy(run), schema)


def digests(documents: DataFrame, path: str, *, keep: list[str], text: str = "text") -> DataFrame:
    """Number and SHA-256 of the ids, and SHA-256 of the decoded text, without moving either out of the worker."""
    content = vocabulary(documents.sparkSession, path)
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def run(data):
        tokenizer = _tokenizer(content)
        numbers = tokenizer.numbers
        ids = tokenizer.encode(_texts(data))
        return {
            "n_tokens": list(map(len, ids)),
            "ids_sha256": [sha(b" ".join([numbers[i] for i in x])) for x in ids],
            "decoded_sha256": [sha(tokenizer.decode(x).encode()) for x in ids],
        }

    return map_texts(documents, text, keep, DIGESTS, run, INDEX_BYTES)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe_pairs(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path(), keep=["doc_id"])
