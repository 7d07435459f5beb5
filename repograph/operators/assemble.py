"""The document of a graph: sections in the order of a walk, joined.

Folders come before files and those before other kinds, then by name; in a file, code comes by line; methods follow their
class. A node's place is an array of (rank, name, line, order) from the root on; sorting by it walks the tree. How deep the tree is
comes from the nodes' ``depth``, where it isn't given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph import constants as K
from repograph.functions.markdown import node_section
from repograph.operators.graph import Graph
from repograph.operators.hierarchy import descend

RANKED = ["FOLDER", "FILE", *K.CONFIG_KINDS]


def roots(nodes: DataFrame) -> DataFrame:
    """Folders without a parent; if there are none, files without one."""
    top = nodes.where("belongs_to IS NULL")
    folders = top.where("node_type = 'FOLDER'")
    any_folder = folders.select(F.lit(1).alias("one")).limit(1)
    files = top.where("node_type = 'FILE'").join(any_folder, F.lit(True), "left_anti")
    return folders.unionByName(files)


def shown(nodes: DataFrame) -> DataFrame:
    """What a document has: folders, files, and code with a line."""
    return nodes.where(F.col("node_type").isin(*RANKED) | F.col("start_line").isNotNull())


def ordered(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes with ``sort_key`` and ``level``; ``nodes`` has seq."""

    def key(_: str):
        rank = F.when(F.col("node_type") == "FOLDER", 0).when(F.col("node_type") == "FILE", 1).when(F.col("node_type").isin(*K.CONFIG_KINDS), 2).otherwise(3)
        by_name = F.when(rank < 3, F.col("name")).otherwise("")
        line = F.when(rank < 3, 0).otherwise(F.col("start_line"))
        return F.struct(rank.alias("rank"), by_name.alias("name"), line.cast("int").alias("line"), F.col("seq").alias("seq"))

    return descend(shown(nodes), key, depth)


def sections(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(sort_key, id, section): the heading of a node is two levels below its depth."""
    rows = ordered(nodes, depth)
    for name, kind in (("imports", "array<struct<code_snippet:string>>"), ("props", "array<string>"), ("hooks_used", "array<string>")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows.select("sort_key", "id", node_section(F.col("level") + 2).alias("section"))


def assemble(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """One row, ``document``: as long as the document, so for one project; ``sections`` is the distributed form."""
    parts = F.sort_array(F.collect_list(F.struct("sort_key", "id", "section")))
    text = F.array_join(F.transform(parts, lambda p: p["section"]), "")
    joined = sections(nodes, depth).agg(text.alias("document"))
    return joined.select(F.when(F.col("document") == "", K.NO_ROOTS).otherwise(F.col("document")).alias("document"))


def html_page(markdown_title: str, body: str) -> str:
    """A plain page around a document's HTML."""
    return f"<!DOCTYPE html>\n<html><head><meta charset='utf-8'><title>{markdown_title}</title></head>\n<body>\n{body}\n</body></html>\n"


def write_sections(graph: Graph, path: str, depth: int | None = None) -> None:
    """The sections as text files in order, so that their concatenation is the document; range-partitioned by place."""
    rows = sections(graph.nodes, depth)
    rows.repartitionByRange("sort_key").sortWithinPartitions("sort_key").select("section").write.option("lineSep", "").text(path)
