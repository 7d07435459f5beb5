"""SimHash near-duplicates of documents through a distributed Gray-order hierarchical index (operator 8).

A document's words are runs of ``[^\\x20\\x09-\\x0D]`` after A-Z is lower-cased; its fingerprint adds up XXH64 (seed 42)
of its space-joined word shingles. Fingerprints link at ``limit`` or fewer differing bits.

The distinct fingerprints are sorted by Gray rank and cut into blocks of consecutive ones; a block is an upper node
of the index, with the bits that its fingerprints share. Their number is bounded (see MAX_BLOCKS), so all tasks get the
patterns of all blocks. Each block sends to each later one those of its fingerprints that can still link there by the
shared bits; block and visitors meet in a join by block, and the block's own levels are searched (``gray_index``). Copies
fall together before that, so a group of copies of any size is one fingerprint; a unit of work is one block with one
packet of visitors, and gives a spanning forest of the links that it finds, not the links.

Defined cases: a null, empty or blank text has the fingerprint zero; a text of fewer words than a shingle is one
shingle; repeated rows get equal rows; a null id counts only where its component has no other, and then the component
is null; an empty table gives an empty one. Long texts are seen whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repograph.llm.components import connected_components
from repograph.llm.gray_index import GrayIndex, forest, gray_rank, shared
from repograph.llm.hashing import U64, simhash
from repograph.llm.shingle_links import band_keys, similar_links
from repograph.llm.storage import Workspace
from repograph.llm.textmap import map_texts, tidy

SEED = 42
LIMIT = 2
#: A block holds BLOCK fingerprints, or more where there would be over MAX_BLOCKS blocks.
BLOCK = 1024
MAX_BLOCKS = 8192
#: Visitors travel in packets of at most so many.
PACKET = 4096
#: So many tasks share a block's visitors.
PARTS = 4
_TOP = U64(1 << 63)


def shingle_hashes(texts: list[bytes | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles, text by text, and how many each text has."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.lower().split() if text else []
        if not own:
            continue
        joined = b" ".join(own)
        if len(own) <= words:
            hashes.append(digest(joined, SEED))
            counts[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
        starts = [0, *ends[: len(own) - words].tolist()]
        stops = (ends[words - 1 :] - 1).tolist()
        hashes += [digest(joined[s:e], SEED) for s, e in zip(starts, stops)]
        counts[i] = len(stops)
    return np.array(hashes, U64), counts


def fingerprints(texts: list[bytes | None], words: int) -> np.ndarray:
    return simhash(*shingle_hashes(texts, words))


def with_fingerprints(documents: DataFrame, keep: list[str], text: str, words: int, name: str = "fp") -> DataFrame:
    """The ``keep`` columns and the fingerprint, its 64 bits as a long."""
    added = T.StructType([T.StructField(name, T.LongType(), False)])
    return map_texts(documents, text, keep, added, lambda texts: {name: pa.array(fingerprints(texts, words).view(np.int64))})


def with_bands(documents: DataFrame, keep: list[str], text: str, words: int) -> DataFrame:
    """As ``with_fingerprints``, and the band keys of the shingles, null where there is none."""
    added = T.StructType([T.StructField("fp", T.LongType(), False), T.StructField("bands", T.ArrayType(T.LongType(), False))])

    def run(texts):
        hashes, counts = shingle_hashes(texts, words)
        return {"fp": pa.array(simhash(hashes, counts).view(np.int64)), "bands": band_keys(hashes, counts)}

    return map_texts(documents, text, keep, added, run)


def _ranked(prints: DataFrame) -> DataFrame:
    """With the Gray rank, shifted so that it sorts as a signed number."""
    schema = T.StructType([*prints.schema.fields, T.StructField("rank", T.LongType(), False)])

    def run(batches):
        for batch in batches:
            codes = batch.column("fp").to_numpy().view(U64)
            rank = (gray_rank(codes) ^ _TOP).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], names=[*batch.schema.names, "rank"])

    return prints.mapInArrow(tidy(run), schema)


def _blocks(ranked: DataFrame, size: int) -> DataFrame:
    """Stretches of ``size`` codes in Gray order: id (the first's rank), mask, pattern, codes."""
    schema = "block long, mask long, pattern long, codes binary"

    def run(batches):
        held: list[np.ndarray] = []
        waiting = 0

        def give(codes):
            starts = np.arange(0, len(codes), size)
            mask, pattern = shared(codes, starts)
            first = (gray_rank(codes[starts]) ^ _TOP).view(np.int64)
            packed = pa.array([codes[s : s + size].tobytes() for s in starts], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(first), pa.array(mask.view(np.int64)), pa.array(pattern.view(np.int64)), packed],
                names=["block", "mask", "pattern", "codes"],
            )

        for batch in batches:
            held.append(batch.column("fp").to_numpy().view(U64))
            waiting += len(held[-1])
            if waiting >= size:
                codes = np.concatenate(held)
                whole = waiting - waiting % size
                yield give(codes[:whole])
                held, waiting = [codes[whole:].copy()], waiting - whole
        if waiting:
            yield give(np.concatenate(held))

    return ranked.repartitionByRange("rank").sortWithinPartitions("rank").select("fp").mapInArrow(tidy(run), schema)


def _visitors(blocks: DataFrame, nodes, limit: int) -> DataFrame:
    """For each block and each later one that its codes may link into: the codes that may, in packets."""

    def run(batches):
        ids, masks, patterns = nodes.value
        for batch in batches:
            own_ids = batch.column("block").to_numpy()
            for own, packed in zip(own_ids, batch.column("codes").to_pylist()):
                codes = np.frombuffer(packed, U64)
                mask, pattern = shared(codes, np.zeros(1, np.int64))
                near = np.bitwise_count((pattern[0] ^ patterns) & mask[0] & masks) <= limit
                to, sent = [], []
                for k in np.flatnonzero(near & (ids >= own)):
                    some = codes[np.bitwise_count((codes ^ patterns[k]) & masks[k]) <= limit]
                    for s in range(0, len(some), PACKET):
                        to.append(int(ids[k]))
                        sent.append(some[s : s + PACKET].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(sent, pa.binary())], names=["block", "visitors"])

    return blocks.select("block", "codes").mapInArrow(tidy(run), "block long, visitors binary")


def _search(blocks: DataFrame, visitors: DataFrame, limit: int) -> DataFrame:
    """Links between the blocks' codes and their visitors. Each block goes to PARTS tasks and its packets to one of them;
    there the block's row comes first, its index is built once, and the packets stream past it."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    homes = blocks.select("block", parts, F.lit(0).alias("kind"), "codes")
    packets = visitors.select("block", F.pmod(F.xxhash64("visitors"), F.lit(PARTS)).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("visitors").alias("codes"))

    def run(batches):
        home, index = None, None
        for batch in batches:
            for block, part, kind, codes in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "kind", "codes"))):
                if not kind:
                    home, index = (block, part), codes
                    continue
                assert home == (block, part)
                if isinstance(index, bytes):  # only once somebody comes
                    index = GrayIndex(np.frombuffer(index, U64))
                found_a, found_b = [], []
                queries = np.frombuffer(codes, U64)
                for s in range(0, len(queries), 512):
                    some = queries[s : s + 512]
                    q, c = index.search(some, limit)
                    a, b = some[q], index.codes[c]
                    found_a.append(a[a != b])
                    found_b.append(b[a != b])
                a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    rows = homes.unionByName(packets).repartition("block", "part").sortWithinPartitions("block", "part", "kind")
    return rows.mapInArrow(tidy(run), "a long, b long")


def link_forest(prints: DataFrame, limit: int, work: Workspace) -> DataFrame:
    """Links (a, b) that connect the distinct ``fp`` of ``prints`` just as all pairs within ``limit`` bits do."""
    spark = prints.sparkSession
    n = prints.count()
    size = max(BLOCK, math.ceil(n / MAX_BLOCKS))
    blocks = work.keep(_blocks(_ranked(prints.select("fp")), size), "blocks")
    # at most MAX_BLOCKS and one for each partition
    rows = blocks.select("block", "mask", "pattern").collect()
    column = lambda k: np.array([r[k] for r in rows], np.int64)
    nodes = spark.sparkContext.broadcast((column(0), column(1).view(U64), column(2).view(U64)))
    return _search(blocks, _visitors(blocks, nodes, limit), limit)


def near_duplicates(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    words: int = 3,
    limit: int = LIMIT,
    carry: tuple[str, ...] = (),
    name: str = "simhash",
    similarity: float | None = None,
) -> DataFrame:
    """(id, fp, component, group) and the ``carry`` columns for each document: fingerprint as a long, the smallest id
    reachable, and the fingerprint that stands for the component. With ``similarity``, texts whose sets of shingles have
    at least that Jaccard similarity link as well, however far apart their fingerprints are."""
    work = Workspace(documents.sparkSession, name)
    source = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"), *(F.col(f"`{c}`") for c in carry))
    if similarity is None:
        prints = work.keep(with_fingerprints(source, ["id", *carry], "text", words), "prints")
    else:
        source = source.withColumn("h", F.xxhash64(F.col("text").cast("string")))
        prints = work.keep(with_bands(source, ["id", "h", *carry], "text", words), "prints")
    classes = work.keep(prints.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    links = link_forest(classes, limit, work)
    if similarity is not None:
        links = work.keep(links, "forest")
        near = links

        def labelled(more):
            found = connected_components(near if more is None else near.union(more), work)
            return work.keep(found.withColumnsRenamed({"node": "fp"}), "linked")

        nodes = work.keep(prints.where("bands IS NOT NULL").select("h", "fp", "bands").dropDuplicates(["h"]), "nodes")
        texts = source.select("h", F.col("text").cast("string").alias("text"))
        links = links.union(similar_links(nodes, texts, lambda t: shingle_hashes(t, words), similarity, labelled, work))
    labels = connected_components(links, work)
    labels = work.keep(labels.withColumnsRenamed({"node": "fp"}), "labels")
    linked = labels.join(classes, "fp")
    least = work.keep(linked.groupBy("label").agg(F.min("first").alias("least")), "least")
    reached = labels.join(least, "label").select("fp", "label", "least")
    component = work.keep(
        classes.join(reached, "fp", "left").select("fp", F.coalesce("least", "first").alias("component"), F.coalesce("label", "fp").alias("group")),
        "components",
    )
    return prints.join(component, "fp").select("id", "fp", "component", "group", *carry)


def one_of_each(documents: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int, limit: int, similarity: float | None = None) -> DataFrame:
    """The rows of ``documents`` without near-duplicates: of each component one row with the smallest id, null last."""
    key, check = "__one_key", "__one_check"
    body = F.col(f"`{text}`").cast("string")
    rows = documents.withColumns({key: F.xxhash64(F.col(f"`{id_col}`"), body), check: F.hash(body)})
    near = near_duplicates(rows, id_col=id_col, text=text, words=words, limit=limit, carry=(key, check), similarity=similarity)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col(key), F.col(check)))
    stays = near.groupBy("group").agg(first.alias("first")).select(F.col(f"first.{key}").alias(key), F.col(f"first.{check}").alias(check))
    # rows that are equal in id and text share a key
    copy = F.row_number().over(Window.partitionBy(key, check).orderBy(F.lit(1)))
    return rows.join(stays, [key, check]).withColumn("__one_copy", copy).where("__one_copy = 1").select(*(F.col(f"`{c}`") for c in documents.columns))


def op8_simhash_gray(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
