"""Benchmark decontamination by winnowing (operator 2).

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is lower-cased. Of every ``window - gram + 1``
consecutive gram hashes the least is kept, in the documents and in the test items, so that two texts that share
``window`` consecutive words share a kept hash. Kept hashes are joined, and each hit is extended to the whole windows
around it, whose words are then compared.

Items of at most ``block_bytes`` of text in all (counted) go to all tasks as one index, and the documents pass it in one
stage without a shuffle. More items are joined instead (``_by_joins``): kept hashes of documents and items by a semi-join,
then the words of the windows around the hits with those of the items, so nothing is broadcast, whatever their number.

Defined cases: a null text has no words; an item with fewer words than ``window`` is one window of all its words; an
item without words matches nothing; a null item id is listed as ``null``; items with equal ids count once; repeated
document rows get equal rows; with no items, or an empty table, nothing is hit; a text of any length is seen whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from repograph.llm.hashing import U64, WORDS_ONLY, gram_hashes, mix, word_bounds, word_hashes
from repograph.llm.storage import Workspace
from repograph.llm.textmap import as_bytes, free_names, map_texts, pieces, prepare, tidy

WINDOW = 10
GRAM = 5
BLOCK_BYTES = 8 << 20

#: Words, spans of hit words (from the first word to past the last) and the ids of the items that hit.
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("n_hit", T.LongType(), False),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]), False),
            False,
        ),
        T.StructField("items", T.ArrayType(T.StringType(), False), False),
    ]
)


def kept(grams: np.ndarray, width: int) -> np.ndarray:
    """Which gram hashes are the least of some ``width`` consecutive ones."""
    out = np.zeros(len(grams), bool)
    n = len(grams) - width + 1
    if n <= 0:
        return out
    least = grams[:n].copy()
    for i in range(1, width):
        np.minimum(least, grams[i : i + n], out=least)
    for i in range(width):
        out[i : i + n] |= grams[i : i + n] == least
    return out


class Index:
    """Kept gram hashes of the items, and by length the windows: sorted hashes, and where each stands in the items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, gram: int):
        self.window, self.gram = window, gram
        self.items = [item for item, _ in items]
        hashes, windows, parts, at = [], {}, [], 0
        for owner, (_, text) in enumerate(items):
            clean = b" ".join(text.translate(WORDS_ONLY).split())
            a, starts, ends = word_bounds(clean)
            if not len(starts):
                continue
            words = word_hashes(a, starts, ends)
            length = min(window, len(words))
            if length == window:
                grams = gram_hashes(words, gram)
                hashes.append(grams[kept(grams, window - gram + 1)])
            found = gram_hashes(words, length)
            n = len(found)
            windows.setdefault(length, []).append((found, np.full(n, owner), at + starts[:n], at + ends[length - 1 :]))
            parts.append(clean)
            at += len(clean)
        self.text = b"".join(parts)
        self.hashes = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, U64)
        self.windows = {}
        for length, own in windows.items():
            columns = [np.concatenate(x) for x in zip(*own)]
            order = np.argsort(columns[0], kind="stable")
            self.windows[length] = [columns[0][order], *(c[order].astype(np.int32) for c in columns[1:])]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> U64(44)).astype(np.int64)] = True

    def joined(self, grams: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The places of grams under the mask whose hash is an item's."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(mask & self.seen[(grams >> U64(44)).astype(np.int64)])
        return at[among(grams[at], self.hashes)]

    def holders(self, length: int, value: np.uint64, words: bytes) -> set[str]:
        """The items with a window of these words."""
        hashes, owner, start, end = self.windows[length]
        out = set()
        for i in range(np.searchsorted(hashes, value), np.searchsorted(hashes, value, "right")):
            if self.text[start[i] : end[i]] == words:
                out.add(self.items[owner[i]])
        return out


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    place = np.searchsorted(ordered, values)
    return ordered[np.minimum(place, len(ordered) - 1)] == values


class Piece:
    """The words of some texts: hashes, places in the buffer, and where each text's words begin."""

    def __init__(self, texts: list[bytes | None]):
        clean = [(t or b"").translate(WORDS_ONLY) for t in texts]
        self.buffer = b" ".join(clean)
        a, self.starts, self.ends = word_bounds(self.buffer)
        sizes = np.fromiter(map(len, clean), np.int64, len(clean)) + 1
        self.bounds = np.append(np.searchsorted(self.starts, np.cumsum(sizes) - sizes), len(self.starts))
        self.words = word_hashes(a, self.starts, self.ends)

    def inside(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of those that end in the text in which they begin."""
        text = np.searchsorted(self.bounds, at, "right") - 1
        fits = at + length <= self.bounds[text + 1]
        return text[fits], at[fits]

    def text(self, start: int, length: int) -> bytes:
        return b" ".join(self.buffer[s:e] for s, e in zip(self.starts[start : start + length].tolist(), self.ends[start : start + length].tolist()))

    def kept_grams(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, hash)."""
        grams = gram_hashes(self.words, gram)
        text, at = self.inside(np.flatnonzero(kept(grams, window - gram + 1)), gram)
        return text, at, grams[at]

    def every(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, hash) of all grams of a short item's length, told apart from others by the length."""
        grams = gram_hashes(self.words, length)
        text, at = self.inside(np.arange(len(grams)), length)
        return text, at, mix(grams[at] + U64(length))


def find(texts: list[bytes | None], index: Index) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """Of each text: the number of words, the spans of hit words, the items."""
    piece = Piece(texts)
    bounds, words = piece.bounds, piece.words
    hits: list[tuple[int, int, set[str]]] = []
    known: dict[bytes, set[str]] = {}
    for length, (ordered, *_) in index.windows.items():
        whole = gram_hashes(words, length)
        if length == index.window:  # the windows around each joined gram
            grams = gram_hashes(words, index.gram)
            at = index.joined(grams, kept(grams, index.window - index.gram + 1))
            first = np.unique((at[:, None] - np.arange(index.window - index.gram + 1)).ravel())
            first = first[(first >= 0) & (first < len(whole))]
            first = first[among(whole[first], ordered)]
        else:
            first = np.flatnonzero(among(whole, ordered))
        text = np.searchsorted(bounds, first, "right") - 1
        for i in first[first + length <= bounds[text + 1]].tolist():
            same = piece.text(i, length)
            if same not in known:
                known[same] = index.holders(length, whole[i], same)
            if known[same]:
                hits.append((i, i + length, known[same]))

    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    hits.sort(key=lambda x: x[:2])
    owners = np.searchsorted(bounds, [h[0] for h in hits], "right") - 1 if hits else []
    for (start, end, found), text in zip(hits, owners):
        spans[text].append((start - int(bounds[text]), end - int(bounds[text])))
        items[text] |= found
    spans = [_joined(x) for x in spans]
    return np.diff(bounds).tolist(), spans, items


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    rows = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.where("text IS NOT NULL")


def _by_joins(documents: DataFrame, items: DataFrame, keep: list[str], text: str, window: int, gram: int, names: list[str]) -> DataFrame:
    work = Workspace(documents.sparkSession, "decontaminate")
    own = [f"k{i}" for i in range(len(keep))]
    rows = documents.select(F.monotonically_increasing_id().alias("row"), *(F.col(f"`{c}`").alias(n) for c, n in zip(keep, own)), F.col(f"`{text}`").cast("string").alias("text"))
    rows = work.keep(rows, "rows")  # from here on a row's number is fixed
    items = work.keep(items, "items")

    def item_windows(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                piece, ids = Piece(as_bytes(part.column("text"))), part.column("item").to_pylist()
                out = []
                for i, (s, e) in enumerate(zip(piece.bounds.tolist(), piece.bounds[1:].tolist())):
                    length = min(window, e - s)
                    out += [(ids[i], length, piece.text(k, length)) for k in range(s, e - length + 1)] if length else []
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.string(), pa.int32(), pa.binary()))], names=["item", "length", "words"])

    windows = work.keep(items.mapInArrow(tidy(item_windows), "item string, length int, words binary").distinct(), "windows")
    # fewer than ``window`` lengths
    short = sorted(r["length"] for r in windows.where(F.col("length") < window).select("length").distinct().collect())

    def keys(texts_of, ids_of, short):
        def run(batches):
            for batch in batches:
                for part in pieces(batch, texts_of):
                    piece, ids = Piece(as_bytes(part.column(texts_of))), part.column(ids_of)
                    for length, (text, at, key) in [(window, piece.kept_grams(window, gram)), *((n, piece.every(n)) for n in short)]:
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(text)), pa.array(np.full(len(at), length, np.int32)), pa.array((at - piece.bounds[text]).astype(np.int32)), pa.array(key.view(np.int64))],
                            names=["id", "length", "place", "key"],
                        )

        return tidy(run)

    whole = F.col("words").cast("string")
    of_items = windows.select(F.col("length").alias("id"), whole.alias("words")).distinct()
    item_keys = of_items.mapInArrow(keys("words", "id", short), "id int, length int, place int, key long").where("id = length").select("length", "key").distinct()
    prints = rows.select("row", "text").mapInArrow(keys("text", "row", short), "id long, length int, place int, key long")
    hits = prints.join(item_keys, ["length", "key"], "left_semi").groupBy(F.col("id").alias("row")).agg(F.collect_set(F.struct("length", "place")).alias("hits"))

    def around(batches):
        """The windows around the hits, with their words."""
        for batch in batches:
            for row, text, hits in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "hits"))):
                piece = Piece([text.encode()])
                n, out = len(piece.starts), set()
                for h in hits:
                    first, last = (h["place"] - (window - gram), h["place"]) if h["length"] == window else (h["place"], h["place"])
                    out |= {(k, h["length"]) for k in range(max(0, first), min(last, n - h["length"]) + 1)}
                found = sorted(out)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row] * len(found), pa.int64()), pa.array([k for k, _ in found], pa.int32()), pa.array([k + m for k, m in found], pa.int32()),
                        pa.array([piece.text(k, m) for k, m in found], pa.binary()),
                    ],
                    names=["row", "start", "end", "words"],
                )

    near = rows.select("row", "text").join(hits, "row").mapInArrow(tidy(around), "row long, start int, end int, words binary")
    near = work.keep(near.join(windows.select("words").distinct(), "words", "left_semi"), "near")
    spans = near.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    held = near.select("row", "words").distinct().join(windows.select("words", "item"), "words")
    held = held.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))

    def finish(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                counts = np.diff(Piece(as_bytes(part.column("text"))).bounds)
                joined = [_joined([(x["start"], x["end"]) for x in spans or ()]) for spans in part.column("spans").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(n) for n in own), pa.array(counts), pa.array([sum(e - s for s, e in x) for x in joined], pa.int64()),
                        pa.array([[{"start": s, "end": e} for s, e in x] for x in joined], to_arrow_type(RESULT["spans"].dataType)),
                        pa.array([x or [] for x in part.column("items").to_pylist()], pa.list_(pa.string())),
                    ],
                    names=[*own, *RESULT.fieldNames()],
                )

    schema = T.StructType([*(T.StructField(n, documents.schema[c].dataType) for n, c in zip(own, keep)), *RESULT.fields])
    done = rows.join(spans, "row", "left").join(held, "row", "left").select(*own, "text", "spans", "items").mapInArrow(tidy(finish), schema)
    return done.toDF(*free_names(keep, names), *names)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    keep: list[str],
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
    prefix: str = "",
) -> DataFrame:
    """The ``keep`` columns with those of RESULT (their names after ``prefix``), a row for each document."""
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    prepare(documents.sparkSession)
    names = [prefix + f.name for f in RESULT.fields]
    items = _items(benchmark, item_id, item_text)
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        return _by_joins(documents, items, keep, text, window, gram, names)
    index = Index([(r["item"], r["text"].encode()) for r in items.toLocalIterator()], window, gram)
    held = documents.sparkSession.sparkContext.broadcast(index)

    def run(texts):
        n, spans, found = find(texts, held.value)
        return {
            names[0]: n,
            names[1]: [sum(e - s for s, e in x) for x in spans],
            names[2]: [[{"start": s, "end": e} for s, e in x] for x in spans],
            names[3]: [sorted(x) for x in found],
        }

    added = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, RESULT.fields)])
    return map_texts(documents, text, keep, added, run)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The whole documents against the whole benchmark."""
    found = decontaminate(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"]
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Every window of the items against every window of the documents, as strings.
OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
k AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
),
s AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)
),
h AS (SELECT s.doc_id, s.i, s.n, k.item_id FROM s JOIN k ON s.n = k.n AND s.k = k.k),
p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY doc_id),
q AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, 'null') AS item FROM h) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""
