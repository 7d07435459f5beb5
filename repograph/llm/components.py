"""Connected components of a graph given by its links, by randomised contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm.storage import Workspace
from repograph.llm.textmap import tidy

#: So many links, 3 MB at most, are few enough for one task to join up what contraction has left.
FINISH = 100_000


def connected_components(links: DataFrame, work: Workspace, finish: int = FINISH) -> DataFrame:
    """(node, label) for every node of ``links`` (columns a, b; long): equal labels, which are nodes, for connected nodes.

    In each round every node moves to the least of itself and its neighbours in an order that is drawn anew by hashing
    with the round's number. Links follow; those that became loops or repeat go. At least about a third of the nodes
    goes each round, whatever the shape, so a chain takes as few rounds as a star. All steps are aggregates with
    map-side combining and joins of stored tables, whose hot partitions Spark can split. Once at most ``finish`` links are
    left (counted, so bounded), one task joins them up; the components are the same. A null end makes no link.
    """
    links = work.keep(_plain(links.select("a", "b")), "links")
    moves = []
    while left := links.count():
        turn = len(moves)
        if left <= finish:
            moves.append(work.keep(_joined_up(links), f"move{turn}"))
            break

        def order(node, turn=turn):
            return F.struct(F.xxhash64(node, F.lit(turn)).alias("h"), node.alias("n"))

        ends = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        least = ends.select(F.col("e.a").alias("a"), F.col("e.b").alias("b")).groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        move = work.keep(least.select(F.col("a").alias("node"), F.least(F.col("m"), order(F.col("a")))["n"].alias("to")), f"move{turn}")
        moves.append(move)
        half = links.join(move.withColumnsRenamed({"node": "a", "to": "a2"}), "a")
        both = half.join(move.withColumnsRenamed({"node": "b", "to": "b2"}), "b")
        links = work.keep(_plain(both.select(F.col("a2").alias("a"), F.col("b2").alias("b"))), f"links{turn}")
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = moves[-1].withColumnRenamed("to", "label")
    for move in reversed(moves[:-1]):
        later = labels.withColumnsRenamed({"node": "to", "label": "later"})
        labels = move.join(later, "to", "left").select("node", F.coalesce("later", "to").alias("label"))
    return labels


def _joined_up(links: DataFrame) -> DataFrame:
    """(node, to) of all nodes of few links, by union-find: to the least node of the component."""

    def run(batches):
        above: dict = {}

        def root(x):
            while above.setdefault(x, x) != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        kind = None
        for batch in batches:
            kind = batch.column("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = root(a), root(b)
                above[max(a, b)] = min(a, b)
        if above:
            yield pa.RecordBatch.from_arrays([pa.array(list(above), kind), pa.array([root(x) for x in list(above)], kind)], names=["node", "to"])

    kind = links.schema["a"].dataType.simpleString()
    return links.coalesce(1).mapInArrow(tidy(run), f"node {kind}, to {kind}")


def _plain(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
