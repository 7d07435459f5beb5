"""Summaries, level by level from the deepest: context, prompt, summariser, and up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph import constants as K
from repograph.functions import scalars as S
from repograph.functions.prompts import prompt
from repograph.operators import contexts
from repograph.operators.graph import Graph
from repograph.tables import keeper

#: Takes (id, prompt) and gives (id, summary). A provider that calls a model belongs here, as a Pandas function.
Summarizer = Callable[[DataFrame], DataFrame]


def extractive(prompts: DataFrame) -> DataFrame:
    """Without a model: what is asked and the first fact, so always the same."""
    lines = F.split("prompt", "\n", 3)
    return prompts.select("id", F.concat_ws(" ", F.get(lines, 0), F.get(lines, 1)).alias("summary"))


SUMMARIZERS: dict[str, Summarizer] = {"extractive": extractive}


def summarizer(name: str) -> Summarizer:
    if name not in SUMMARIZERS:
        raise ValueError(f"no summarizer {name!r}; there are {sorted(SUMMARIZERS)}")
    return SUMMARIZERS[name]


def fixed_summary(has_contents, has_imports):
    """What needs no summariser: done already, or nothing there. Null for the rest."""
    done = F.col("summary").isNotNull() & (F.col("summary") != K.FAILED_SUMMARY)
    return (
        F.when(done, F.col("summary"))
        .when(F.col("node_type").isin(*K.CONFIG_KINDS) & (F.col("raw_content") == K.EMPTY_FILE), K.EMPTY_FILE_SUMMARY)
        .when((F.col("node_type") == "FILE") & ~has_contents & ~has_imports, K.EMPTY_PYTHON_SUMMARY)
        .when((F.col("node_type") == "FOLDER") & ~has_contents, K.EMPTY_FOLDER_SUMMARY)
    )


def prompts(graph: Graph, imports: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(id, prompt) from the contexts of the nodes ``of``, by default all."""
    kinds = {
        "FUNCTION": contexts.function_context(graph, of), "CLASS": contexts.class_context(graph, of), "NON_FUNCTION_NON_CLASS": contexts.top_level_context(graph, of),
        "IMPORT_BLOCK": contexts.import_block_context(graph, imports, of), "REACT_COMPONENT": contexts.component_context(graph, of), "REACT_HOOK": contexts.hook_context(graph, of),
        "FILE": contexts.file_context(graph, of), "FOLDER": contexts.folder_context(graph, of),
    }
    kinds |= {k: (graph.nodes if of is None else of).where(F.col("node_type") == k) for k in K.CONFIG_KINDS}
    out = None
    for kind, rows in kinds.items():
        made = rows.select("id", prompt(kind).alias("prompt"))
        out = made if out is None else out.unionByName(made)
    return out


def summarise_level(graph: Graph, imports: DataFrame, depth: int, summarise: Summarizer) -> DataFrame:
    """(id, summary) of the nodes of a level; those below have theirs in ``graph``."""
    here = graph.nodes.where(F.col("depth") == depth)
    ids = here.select(F.col("id").alias("source_id"))
    edges = graph.collapsed.where("type IN ('CONTAINS', 'IMPORTS')").join(ids, "source_id", "left_semi").groupBy(F.col("source_id").alias("id"))
    made = edges.agg(F.max(F.col("type") == "CONTAINS").alias("has_contents"), F.max(F.col("type") == "IMPORTS").alias("has_imports"))
    rows = here.join(made, "id", "left").fillna(False, ["has_contents", "has_imports"])
    rows = rows.withColumn("fixed", fixed_summary(F.col("has_contents"), F.col("has_imports")))
    asked = rows.where("fixed IS NULL").drop("fixed", "has_contents", "has_imports")
    told = summarise(prompts(graph, imports, asked)).select("id", S.clean_summary(F.col("summary")).alias("made"))
    return rows.select("id", "fixed").join(told, "id", "left").select("id", F.coalesce("fixed", "made", F.lit(K.FAILED_SUMMARY)).alias("summary"))


def summarise(
    graph: Graph, imports: DataFrame, depth: int | None = None, summarise_with: Summarizer = extractive, keep: Callable[[DataFrame, str], DataFrame] | None = None
) -> Graph:
    """The graph with summaries, from the deepest level (by default that of the nodes) up.

    ``keep`` stores a table and reads it again, by default below the shared folder: the nodes, the collapsed edges and each
    level's summaries, so what a level runs doesn't grow with the levels done.
    """
    keep = keep or keeper(graph.nodes.sparkSession, "summaries")
    if depth is None:
        depth = graph.nodes.agg(F.max("depth")).first()[0]
    nodes, view = keep(graph.nodes, "nodes"), keep(graph.collapsed, "collapsed")
    done = None
    for level in range(-1 if depth is None else depth, -1, -1):
        now = Graph(_with_summaries(nodes, done), graph.edges, view)
        made = keep(summarise_level(now, imports, level, summarise_with), f"summaries-{level}")
        done = made if done is None else done.unionByName(made)
    return Graph(_with_summaries(nodes, done), graph.edges, view)


def _with_summaries(nodes: DataFrame, done: DataFrame | None) -> DataFrame:
    if done is None:
        return nodes
    return nodes.join(done.withColumnRenamed("summary", "__made"), "id", "left").withColumn("summary", F.coalesce("__made", "summary")).drop("__made")


def overview(graph: Graph) -> DataFrame:
    """(id, prompt) of the project: the root folder and its children's summaries."""
    root = contexts.folder_context(graph).where("depth = 0")
    return root.select("id", prompt("PROJECT").alias("prompt"))


def level_counts(nodes: DataFrame) -> DataFrame:
    """(depth, ok, failed), and with a null depth those of all."""
    usable = S.usable_summary(F.col("summary"))
    return nodes.rollup("depth").agg(F.count_if(usable).alias("ok"), F.count_if(~usable).alias("failed"))
