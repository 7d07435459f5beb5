"""Links between texts whose sets of word shingles have a Jaccard similarity of at least a limit.

Candidates agree on all ROWS minima of one of BANDS bands of a MinHash sketch: at a similarity of 0.8 a pair is missed with
a chance of 3e-6. Each candidate is verified by the whole sets. Members of a bucket go with its first text; those that aren't
connected to it then go with the first of themselves, and at last with all members that are still in another component. The
components are part of the joins, so what is connected already makes no rows, and the components are those of all candidates.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm.hashing import U64, mix
from repograph.llm.marks import bitmap, marked
from repograph.llm.storage import Workspace
from repograph.llm.textmap import as_bytes, pieces, tidy

BANDS, ROWS = 24, 4
_TURN = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_TIMES = mix(_TURN) | U64(1)


def band_keys(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray | None]:
    """The keys of each run of ``counts`` hashes, as longs; None for an empty run."""
    out: list[np.ndarray | None] = [None] * len(counts)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    own = counts[full]
    starts = np.cumsum(own) - own
    keys = np.empty((len(full), BANDS), U64)
    for band in range(BANDS):
        key = np.full(len(full), band + 1, U64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key + np.minimum.reduceat((hashes ^ _TURN[k]) * _TIMES[k], starts))
        keys[:, band] = key
    for i, row in zip(full, keys.view(np.int64)):
        out[i] = row
    return out


def _wanted_sets(texts: DataFrame, wanted: DataFrame, hashed: Callable) -> DataFrame:
    """(h, set) with the sorted shingle hashes of each of ``wanted``, of (h, text)."""
    held = bitmap(wanted)

    def run(batches):
        for batch in batches:
            some = batch.filter(pa.array(marked(held.value, batch.column("h").to_numpy())))
            for piece in pieces(some, "text"):
                found = {}
                for h, text in zip(piece.column("h").to_pylist(), as_bytes(piece.column("text"))):
                    if h not in found:
                        found[h] = np.unique(hashed([text])[0]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["h", "set"])

    return texts.mapInArrow(tidy(run), "h long, set binary").join(wanted, "h", "left_semi").groupBy("h").agg(F.min("set").alias("set"))


def _verified(pairs: DataFrame, texts: DataFrame, hashed: Callable, similarity: float, work: Workspace) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    if pairs.isEmpty():
        return pairs
    wanted = work.keep(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "wanted")
    sets = work.keep(_wanted_sets(texts, wanted, hashed), "sets")
    for end in ("a", "b"):
        pairs = pairs.join(sets.withColumnsRenamed({"h": end, "set": f"set_{end}"}), end)

    def run(batches):
        for batch in batches:
            like = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(a.as_py(), U64), np.frombuffer(b.as_py(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                like.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(like, pa.bool_()))

    return work.keep(pairs.select("a", "b", "set_a", "set_b").mapInArrow(tidy(run), "a long, b long"), "similar")


def _apart(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b), once each, of rows with different labels."""
    return pairs.where("label_a <> label_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_links(
    nodes: DataFrame, texts: DataFrame, hashed: Callable, similarity: float, labelled: Callable[[DataFrame | None], DataFrame], work: Workspace
) -> DataFrame:
    """(a, b) of prints: more links for ``nodes`` (h, fp, bands), one for each text in ``texts`` (h, text).

    ``labelled`` gives (fp, label) of the components so far, with more links.
    """

    def own(links):
        return work.keep(nodes.select("h", "fp").join(labelled(links), "fp", "left").select("h", F.coalesce("label", "fp").alias("label")), "own")

    def told(rows, end, labels):
        """Rows (key, h) as (key, ``end``, its label)."""
        return rows.select("key", "h").join(labels, "h").select("key", F.col("h").alias(end), F.col("label").alias(f"label_{end}"))

    def of_prints(pairs):
        for end in ("a", "b"):
            pairs = pairs.join(nodes.select(F.col("h").alias(end), F.col("fp").alias(f"fp_{end}")), end)
        return pairs.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))

    def verified(pairs):
        return work.keep(of_prints(_verified(pairs, texts, hashed, similarity, work)), "verified")

    def with_first(rows, labels):
        """(key, a, label_a, b, label_b) of each row and the first of its bucket."""
        first = rows.groupBy("key").agg(F.min("h").alias("h"))
        return told(rows, "a", labels).join(told(first, "b", labels), "key")

    keyed = nodes.select("h", F.explode("bands").alias("key"))
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = work.keep(keyed.join(several, "key"), "members")
    first = work.keep(_apart(with_first(members, own(None))), "first")
    links = verified(first)
    labels = own(links)
    alone = with_first(members, labels).where("label_a <> label_b").select("key", F.col("a").alias("h"))
    alone = work.keep(alone, "alone")
    second = work.keep(_apart(with_first(alone, labels)).join(first, ["a", "b"], "left_anti"), "second")
    links = links.union(verified(second))
    labels = own(links)
    across = told(alone, "a", labels).join(told(members, "b", labels), "key")
    third = work.keep(_apart(across).join(first.union(second), ["a", "b"], "left_anti"), "third")
    return work.keep(links.union(verified(third)).distinct(), "links")
