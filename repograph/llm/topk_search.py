"""Exact top-k search by inner product through a pivot-distance index (operator 10).

Vectors get one more component, sqrt(M - |x|^2) with M the largest squared norm, queries get 0 there; then the distance of
a query to a vector falls as their inner product grows, and the triangle inequality holds. A vector's key is its nearest
pivot and its distance to it. Rows sorted by key are packed into annuli: stretches of at most ANNULUS vectors of one pivot,
between two distances. For a query at distance d from the pivot, no vector of an annulus [a, b] is nearer than a - d or
d - b. Annuli lie in at most PIVOTS * SHELLS shells, cut at quantiles of the distances, whose bounds go to all tasks.

Queries expand in two steps, each one join of packets of queries with the annuli of the shells that they visit. First each
visits the shell of the least bound, with the k-th best score of a sample as what must be reached; that gives a k-th best
near the final one. Then it visits all other shells that the triangle inequality doesn't rule out at this score, and in
them the annuli that it doesn't rule out. So the plan is the same for any number of queries, and nothing of them is collected.

Components are floor(scale * x), so scores are integers; bounds are in floating point, with slack, and only ever leave out
what is worse. Pivots come from a bounded sample of SAMPLE vectors; all vectors are indexed, and all results exact.

Defined cases: a vector that is null or holds a null, NaN or infinity takes no part, nor does one without an id or with a
squared norm of 2^62 or more, whose scores would not fit; a shorter vector counts as padded with zeros; rows with a
repeated id are candidates each, but the query is the smallest such vector; no candidates give no rows; an empty table
gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograph.llm.storage import Workspace
from repograph.llm.textmap import tidy

SCALE = 256
PIVOTS = 32
SAMPLE = 1024
#: Of each pivot.
SHELLS = 16
#: Most vectors of an annulus and most queries of a packet; fewer, if these take more than PACKED bytes.
ANNULUS = 512
PACKET = 512
PACKED = 1 << 20
#: Relative slack of the bounds, far over the rounding of sums of doubles.
SLACK = 1e-9


def quantised(vectors: DataFrame, id_col: str, column: str, scale: int) -> DataFrame:
    """(id, norm, vector): squared norm, and the components as packed 32-bit integers, of rows that take part."""

    def run(batches):
        for batch in batches:
            values = batch.column("vector")
            flat = np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            ids, norms, packed = [], [], []
            for key, end, start, some in zip(batch.column("id").to_pylist(), ends, np.append(0, ends[:-1]), values.is_valid().to_pylist()):
                own = flat[start:end]
                if not some or key is None or not np.isfinite(own).all():
                    continue
                own = np.floor(scale * own)
                if (own @ own) >= 2.0**62 * (1 - 1e-9):
                    continue
                whole = own.astype(np.int64)
                ids.append(key)
                norms.append(int(whole @ whole))
                packed.append(whole.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(norms, pa.int64()), pa.array(packed, pa.binary())], names=["id", "norm", "vector"])

    source = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("vector"))
    return source.mapInArrow(tidy(run), "id long, norm long, vector binary")


def unpacked(vectors: list[bytes], width: int) -> np.ndarray:
    """A row of 64-bit integers for each vector, padded to ``width``."""
    if all(len(v) == 4 * width for v in vectors):
        return np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), width).astype(np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        own = np.frombuffer(v, "<i4")
        row[: len(own)] = own
    return out


def raised(x: np.ndarray, most: int) -> np.ndarray:
    """With the component that makes all norms equal."""
    norm = (x * x).sum(axis=1)
    return np.concatenate([x.astype(np.float64), np.sqrt(np.maximum(most - norm, 0).astype(np.float64))[:, None]], axis=1)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T
    return np.sqrt(np.maximum(square, 0.0))


def choose_pivots(x: np.ndarray, pivots: int, rounds: int = 5) -> np.ndarray:
    """Far points first, then means of what is nearest to each."""
    chosen = [0]
    near = distances(x, x[:1])[:, 0]
    while len(chosen) < min(pivots, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    centres = x[chosen]
    for _ in range(rounds):
        own = distances(x, centres).argmin(axis=1)
        centres = np.stack([x[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
    return centres


def build_index(rows: DataFrame, width: int, most: int, centres: np.ndarray, work: Workspace, annulus: int = ANNULUS) -> DataFrame:
    """(pivot, least, most, ids, vectors, shell): annuli, packed. Shells have numbers below pivots * SHELLS."""

    def keyed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vector").to_pylist()
            pivot, far = [], []
            for s in range(0, len(vectors), 2048):
                d = distances(raised(unpacked(vectors[s : s + 2048], width), most), centres)
                pivot.append(d.argmin(axis=1))
                far.append(d.min(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(pivot).astype(np.int32)), pa.array(np.concatenate(far)), batch.column("id"), batch.column("vector")],
                names=["pivot", "far", "id", "vector"],
            )

    def packed(batches):
        held: list[tuple] = []

        def give():
            vectors = unpacked([v for *_, v in held], width).astype("<i4").tobytes()
            ids = np.array([r[2] for r in held], "<i8").tobytes()
            least, most_ = held[0][1], held[-1][1]
            return [held[0][0], least, most_, ids, vectors]

        def batch_of(annuli):
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*annuli), kinds)], names=["pivot", "least", "most", "ids", "vectors"])

        for batch in batches:
            annuli = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("pivot", "far", "id", "vector"))):
                if held and (held[0][0] != row[0] or len(held) >= annulus):
                    annuli.append(give())
                    held = []
                held.append(row)
            if annuli:
                yield batch_of(annuli)
        if held:
            yield batch_of([give()])

    keys = rows.mapInArrow(tidy(keyed), "pivot int, far double, id long, vector binary")
    # the id is part of the order, so that any number of equal vectors is dealt to several tasks
    ordered = keys.repartitionByRange("pivot", "far", "id").sortWithinPartitions("pivot", "far", "id")
    annuli = work.keep(ordered.mapInArrow(tidy(packed), "pivot int, least double, most double, ids binary, vectors binary"), "annuli")
    # a row for each pivot, of SHELLS numbers
    cuts = annuli.groupBy("pivot").agg(F.percentile_approx("least", [k / SHELLS for k in range(1, SHELLS)], 1000).alias("cuts"))
    nth = F.size(F.filter("cuts", lambda c: c <= F.col("least")))
    shelled = annuli.join(F.broadcast(cuts), "pivot").withColumn("shell", (F.col("pivot") * SHELLS + nth).cast("int"))
    return work.keep(shelled.drop("cuts"), "shells")


class Best:
    """The k best (score, id) of each query; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.queries = queries

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.searchsorted(query, query)
        top = np.arange(len(query)) - first < self.k
        self.query, self.score, self.id = query[top], score[top], ids[top]

    def kth(self) -> np.ndarray:
        """The k-th best score of each query; the least number where there are fewer."""
        out = np.full(self.queries, np.iinfo(np.int64).min)
        full = np.bincount(self.query, minlength=self.queries) >= self.k
        last = np.searchsorted(self.query, np.arange(self.queries), "right") - 1
        out[full] = self.score[last[full]]
        return out


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point where no sum can leave its whole numbers."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    bound = np.abs(q).max() * float(np.abs(x).max()) * q.shape[1]
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if bound < 2**52 else q @ x.T


class Queries:
    """Ids, vectors and the scores to reach, packed into a row."""

    @staticmethod
    def pack(ids: np.ndarray, q: np.ndarray, reach: np.ndarray) -> tuple[bytes, bytes, bytes]:
        return ids.astype("<i8").tobytes(), q.astype("<i4").tobytes(), reach.astype("<i8").tobytes()

    @staticmethod
    def unpack(ids: bytes, q: bytes, reach: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.frombuffer(ids, "<i8")
        return own, np.frombuffer(q, "<i4").reshape(len(own), width).astype(np.int64), np.frombuffer(reach, "<i8")


def bounds(to_pivot: np.ndarray, pivot: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """No vector of a stretch is nearer to the query than this: a row for each query, a column for each stretch."""
    d = to_pivot[:, pivot]
    return np.maximum(np.maximum(least[None, :] - d, d - most[None, :]), 0.0)


def reaches(bound: np.ndarray, q: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Whether something at that distance may have the score: |q|^2 + M - 2 score is the squared distance of what has it."""
    far = np.sqrt(np.maximum((q * q).sum(axis=1) + float(most) - 2.0 * score, 0.0))
    return bound <= (far * (1 + SLACK) + SLACK * math.sqrt(most + 1.0))[:, None]


def _flat(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], axis=1)


def visits(asked: DataFrame, context, first: bool, packet: int) -> DataFrame:
    """Packets of queries with a shell to visit: the first of each query, or all others that it may have to.

    ``asked`` has id and vector, and for the others ``reach``, null where fewer than k were found, and ``shell``, the first.
    """

    def run(batches):
        width, most, k, centres, known, known_ids, pivot, least, far, shells = context.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            q = unpacked(batch.column("vector").to_pylist(), width)
            bound = bounds(distances(_flat(q), centres), pivot, least, far)
            if first:
                best = Best(len(q), k)
                for s in range(0, len(known), 256):
                    got = inner(q, known[s : s + 256])
                    row, col = np.nonzero(ids[:, None] != known_ids[None, s : s + 256])
                    best.add(row, got[row, col], known_ids[s : s + 256][col])
                reach = best.kth()
                wanted = np.zeros(bound.shape, bool)
                wanted[np.arange(len(q)), bound.argmin(axis=1)] = True
            else:
                lowest = np.iinfo(np.int64).min
                reach = np.array([lowest if r is None else r for r in batch.column("reach").to_pylist()], np.int64)
                wanted = reaches(bound, q, reach, most)
                wanted &= batch.column("shell").to_numpy()[:, None] != shells[None, :]
            rows = []
            for k_ in np.flatnonzero(wanted.any(axis=0)):
                some = np.flatnonzero(wanted[:, k_])
                rows += [(int(shells[k_]), *Queries.pack(ids[x], q[x], reach[x])) for x in (some[s : s + packet] for s in range(0, len(some), packet))]
            if rows:
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["shell", "asked_ids", "queries", "reach"])

    return asked.mapInArrow(tidy(run), "shell int, asked_ids binary, queries binary, reach binary")


FOUND = "query_id long, vec_id long, score long, shell int"


def search(packets: DataFrame, index: DataFrame, context) -> DataFrame:
    """What the packets' queries find in the shells that they visit: of each annulus the k best that reach the score."""

    def run(batches):
        width, most, k, centres, *_ = context.value
        last, held = None, None
        columns = ("asked_ids", "queries", "reach", "pivot", "least", "most", "ids", "vectors", "shell")
        for batch in batches:
            for asked, queries, reach, pivot, least, far, own, vectors, shell in zip(*(batch.column(c).to_pylist() for c in columns)):
                if (asked, reach) != last:
                    last, (ids, q, score) = (asked, reach), Queries.unpack(asked, queries, reach, width)
                    held = distances(_flat(q), centres)
                bound = bounds(held, np.array([pivot]), np.array([least]), np.array([far]))
                some = np.flatnonzero(reaches(bound, q, score, most)[:, 0])
                if not len(some):
                    continue
                own = np.frombuffer(own, "<i8")
                x = np.frombuffer(vectors, "<i4").reshape(len(own), width).astype(np.int64)
                got = inner(q[some], x)
                row, column = np.nonzero((got >= score[some][:, None]) & (ids[some][:, None] != own[None, :]))
                best = Best(len(some), k)
                best.add(row, got[row, column], own[column])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some][best.query]), pa.array(best.id), pa.array(best.score), pa.array(np.full(len(best.id), shell, np.int32))],
                    names=["query_id", "vec_id", "score", "shell"],
                )

    joined = packets.join(index, "shell").select("asked_ids", "queries", "reach", "pivot", "least", "most", "ids", "vectors", "shell")
    return joined.mapInArrow(tidy(run), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    queries: Column,
    *,
    k: int = 5,
    id_col: str = "vec_id",
    column: str = "embedding",
    scale: int = SCALE,
    pivots: int = PIVOTS,
    sample: int = SAMPLE,
    packet: int = PACKET,
    annulus: int = ANNULUS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` (of its ``id``) picks, its k best others."""
    spark = vectors.sparkSession
    work = Workspace(spark, "top-k")
    rows = work.keep(quantised(vectors, id_col, column, scale), "vectors")
    facts = rows.agg(F.max("norm"), F.max(F.octet_length("vector")), F.count("*")).first()
    if not facts[2] or not facts[1]:
        # no components: every score is zero
        most, width = 0, 1
    else:
        most, width = int(facts[0]), int(facts[1]) // 4
    fit = max(1, PACKED // (4 * width))
    some = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(sample).collect()
    known = unpacked([bytes(r["vector"]) for r in some], width) if some else np.zeros((0, width), np.int64)
    known_ids = np.array([r["id"] for r in some], np.int64)
    centres = choose_pivots(raised(known if len(known) else np.zeros((1, width), np.int64), most), pivots)
    index = build_index(rows, width, most, centres, work, min(annulus, fit))
    # at most pivots * SHELLS rows
    shells = index.groupBy("shell").agg(F.min("pivot"), F.min("least"), F.max("most")).orderBy("shell").collect()
    held = [np.array([r[i] for r in shells], t) for i, t in ((1, np.int64), (2, np.float64), (3, np.float64), (0, np.int64))]
    context = spark.sparkContext.broadcast((width, most, k, centres, known, known_ids, *held))
    asked = work.keep(rows.where(queries).groupBy("id").agg(F.min("vector").alias("vector")), "asked")
    if not shells:
        return _ranked(spark.createDataFrame([], FOUND), k).select("query_id", "rank", "vec_id", "score")
    near = work.keep(search(visits(asked, context, True, min(packet, fit)), index, context), "near")
    best = _ranked(near, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("reach"))
    # the first shell, also of a query that found nothing in it
    went = asked.mapInArrow(tidy(_first_shell(context)), "query_id long, shell int").join(best, "query_id", "left")
    others = asked.join(went.withColumnRenamed("query_id", "id"), "id")
    far = search(visits(others, context, False, min(packet, fit)), index, context)
    return _ranked(near.union(far), k).select("query_id", "rank", "vec_id", "score")


def _first_shell(context):
    def run(batches):
        width, most, k, centres, known, known_ids, pivot, least, far, shells = context.value
        for batch in batches:
            if batch.num_rows:
                q = unpacked(batch.column("vector").to_pylist(), width)
                bound = bounds(distances(_flat(q), centres), pivot, least, far)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shells[bound.argmin(axis=1)].astype(np.int32))], names=["query_id", "shell"])

    return run


def op10_topk_pivots(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
