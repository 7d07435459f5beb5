"""A property graph as two DataFrames, and the operators on it.

``nodes`` has id, node_type, name, depth, belongs_to, seq and what else its kinds have; ``edges`` has source_id, target_id,
type, label, seq and may hold several edges between two nodes. ``seq`` is the order in which rows were added, and decides
everything that depends on order. The collapsed view has one edge for an ordered pair: at the place of the first, with
the type and label of the last.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.operators.aggregates import ordered_list


def last_write(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row a key, the last by ``seq``; a single aggregate with map-side combining."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__last")).select(*keys, *(F.col(f"__last.{c}").alias(c) for c in rest))


def first_match(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    return df.groupBy(*keys).agg(picked).select(*keys, *(F.col(f"__first.{c}").alias(c) for c in rest))


def collapse(edges: DataFrame) -> DataFrame:
    """source_id, target_id, type, label, pos."""
    last = F.max_by(F.struct("type", "label"), F.col("seq"))
    grouped = edges.groupBy("source_id", "target_id").agg(F.min("seq").alias("pos"), last.alias("last"))
    return grouped.select("source_id", "target_id", F.col("last.type").alias("type"), F.col("last.label").alias("label"), "pos")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    #: The collapsed view, where it is stored already.
    stored_view: DataFrame | None = None

    @cached_property
    def collapsed(self) -> DataFrame:
        return collapse(self.edges) if self.stored_view is None else self.stored_view

    def find(self, node_type: str | None = None, depth: int | None = None, **attributes) -> DataFrame:
        """Nodes of a type and depth whose attributes are equal; None asks for nodes that have none."""
        out = self.nodes
        if node_type is not None:
            out = out.where(F.col("node_type") == node_type)
        if depth is not None:
            out = out.where(F.col("depth") == depth)
        for name, value in attributes.items():
            if name in self.nodes.columns:
                out = out.where(F.col(name).eqNullSafe(F.lit(value)))
            elif value is not None:
                out = out.where(F.lit(False))
        return out

    def get(self, node_id) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def contains(self, node_id) -> bool:
        return not self.get(node_id).isEmpty()

    def count(self) -> int:
        return self.nodes.count()

    def view(self, edge_type: str | None) -> DataFrame:
        """(source_id, target_id, type, label, pos) of the collapsed view, of a type or all."""
        return self.collapsed if edge_type is None else self.collapsed.where(F.col("type") == edge_type)

    def may_lead(self, edge_type: str, node_type: str) -> bool:
        """Whether edges of that type can end at nodes of that type."""
        return True

    def successors(self, edge_type: str | None = None, of: DataFrame | None = None) -> DataFrame:
        """(source_id, pos) and the target's columns; ``of`` has the source ids, else all. Order by pos."""
        edges = self.view(edge_type)
        if of is not None:
            edges = edges.join(of.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
        return edges.select("source_id", "pos", F.col("target_id").alias("id")).join(self.nodes, "id")

    def bases(self, of: DataFrame | None = None) -> DataFrame:
        """(id, runs): the names of the classes that a class inherits from, in order, as runs (name, n) of equal names."""
        rows = self.successors("INHERITS_FROM", of).where("node_type = 'CLASS'")
        return rows.groupBy(F.col("source_id").alias("id")).agg(ordered_list(F.struct("name", F.lit(1).alias("n")), F.col("pos")).alias("runs"))

    def predecessors(self, edge_type: str | None = None, of: DataFrame | None = None) -> DataFrame:
        """(target_id, pos) and the source's columns."""
        edges = self.view(edge_type)
        if of is not None:
            edges = edges.join(of.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi")
        return edges.select("target_id", "pos", F.col("source_id").alias("id")).join(self.nodes, "id")

    def children(self) -> DataFrame:
        """(parent_id, id), once each, by the edges to parents."""
        return self.view("IS_PART_OF").select(F.col("target_id").alias("parent_id"), F.col("source_id").alias("id")).distinct()

    def out_edges(self, edge_type: str | None = None) -> DataFrame:
        """All edges as they were added, also several between two nodes."""
        return self.edges if edge_type is None else self.edges.where(F.col("type") == edge_type)

    def in_edges(self, edge_type: str | None = None) -> DataFrame:
        """Edges of the collapsed view."""
        return self.view(edge_type)

    def dangling(self) -> DataFrame:
        """Edges with an end that is no node."""
        ids = self.nodes.select("id")
        no_source = self.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
        known = self.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
        no_target = known.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
        return no_source.select(*self.edges.columns).unionByName(no_target.select(*self.edges.columns))

    def max_depth(self) -> DataFrame:
        return self.nodes.agg(F.max("depth").alias("max_depth"))

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree) over the collapsed view."""
        ends = self.collapsed.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o")))).alias("e"))
        counts = ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.o").alias("out_degree"), F.sum(1 - F.col("e.o")).alias("in_degree"))
        return self.nodes.select("id").join(counts, "id", "left").fillna(0, ["out_degree", "in_degree"])


def node_link_json(graph: Graph) -> DataFrame:
    """One JSON line a node and a collapsed edge, without null fields; ``kind`` is node or link."""
    nodes = graph.nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*graph.nodes.columns)).alias("json"))
    links = graph.collapsed.select(
        F.lit("link").alias("kind"), F.to_json(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type", "label")).alias("json")
    )
    return nodes.unionByName(links)
