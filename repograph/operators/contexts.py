"""What is told of a node when it is summarised: neighbours and children as ordered lists, gathered with one aggregate each.

``of`` are the nodes that are told of, by default all; edges of others are left out before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.functions import scalars as S
from repograph.operators.aggregates import ordered_list
from repograph.operators.graph import Graph

def _named(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def caller_text() -> Column:
    return _named("`", F.col("name"), "` (", F.col("node_type"), " in `", F.coalesce("file_path", F.lit("None")), "`)")


def callee_text() -> Column:
    return _named("`", F.col("name"), "` (", F.col("node_type"), ")")


def module_text() -> Column:
    return F.when(F.coalesce("module_path", F.lit("")) != "", _named("`", F.col("module_path"), "`")).otherwise(_named("(File: `", F.col("name"), "`)"))


def _gather(rows: DataFrame, key: str, text: Column, name: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("id")).agg(ordered_list(text, F.col("pos")).alias(name))


def callers(graph: Graph, edge_type: str = "CALLS", of: DataFrame | None = None) -> DataFrame:
    return _gather(graph.predecessors(edge_type, of), "target_id", caller_text(), "callers")


def callees(graph: Graph, of: DataFrame | None = None) -> DataFrame:
    return _gather(graph.successors("CALLS", of), "source_id", callee_text(), "callees")


def imports_used(graph: Graph, edge_type: str = "USES_IMPORT", name: str = "imports_used", of: DataFrame | None = None) -> DataFrame:
    return _gather(graph.successors(edge_type, of).where("node_type = 'FILE'"), "source_id", module_text(), name)


def children(graph: Graph, of: DataFrame | None = None) -> DataFrame:
    """(parent, pos) and the child's columns, in the order of the edges."""
    return graph.successors("CONTAINS", of).withColumnRenamed("source_id", "parent")


def _nodes(graph: Graph, kind: str, of: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The nodes of a kind, among ``of`` if that is given, and their ids for the edges' joins."""
    rows = (graph.nodes if of is None else of).where(F.col("node_type") == kind)
    return rows, None if of is None else rows.select("id")


def summary_map(rows: DataFrame, parent: str = "parent") -> DataFrame:
    """(id, component_summaries): ``TYPE: name`` to summary, as an ordered array of (key, value).

    A key that comes again keeps its first place and takes the last value; summaries that failed are left out.
    """
    usable = rows.where(S.usable_summary(F.col("summary"))).withColumn("key", _named(F.col("node_type"), ": ", F.col("name")))
    once = usable.groupBy(F.col(parent).alias("id"), "key").agg(F.min("pos").alias("first"), F.max_by("summary", "pos").alias("value"))
    return once.groupBy("id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("first", "key", "value"))), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))).alias("component_summaries")
    )


def _with(nodes: DataFrame, *parts: DataFrame) -> DataFrame:
    """Nodes with the parts' lists, empty where a node has none."""
    for part in parts:
        names = [c for c in part.columns if c != "id"]
        nodes = nodes.drop(*names).join(part, "id", "left")
        for n in names:
            nodes = nodes.withColumn(n, F.coalesce(F.col(n), F.array().cast(part.schema[n].dataType)))
    return nodes


def function_context(graph: Graph, of: DataFrame | None = None) -> DataFrame:
    rows, ids = _nodes(graph, "FUNCTION", of)
    classes = graph.nodes.where("node_type = 'CLASS'").select(F.col("id").alias("belongs_to"), F.col("name").alias("class_name"))
    rows = rows.join(classes, "belongs_to", "left")
    rows = rows.withColumn("class_name", F.when(F.coalesce("is_method", F.lit(False)), F.col("class_name")))
    return _with(rows, callers(graph, of=ids), callees(graph, ids), imports_used(graph, of=ids))


def class_context(graph: Graph, of: DataFrame | None = None) -> DataFrame:
    """``imports_used`` of a class is always empty."""
    rows, ids = _nodes(graph, "CLASS", of)
    methods = graph.successors("CONTAINS", ids).where("node_type = 'FUNCTION' AND is_method")
    shown = F.when(F.coalesce("signature", F.lit("")) != "", F.col("signature")).otherwise(F.col("name"))
    rows = rows.withColumn("imports_used", F.array().cast("array<string>"))
    rows = _with(rows, graph.bases(ids), _gather(methods, "source_id", _named("`", shown, "`"), "methods"))
    # runs are written out after the joins: a name that many classes bear makes long lists
    names = F.flatten(F.transform("runs", lambda r: F.array_repeat(_named("`", r["name"], "`"), r["n"].cast("int"))))
    return rows.withColumn("inherits_from", names).drop("runs")


def top_level_context(graph: Graph, of: DataFrame | None = None) -> DataFrame:
    rows, ids = _nodes(graph, "NON_FUNCTION_NON_CLASS", of)
    return _with(rows, callees(graph, ids).withColumnRenamed("callees", "calls_made"), imports_used(graph, of=ids))


def component_context(graph: Graph, of: DataFrame | None = None) -> DataFrame:
    """Callers are those that render it, then those that call it."""
    own, _ = _nodes(graph, "REACT_COMPONENT", of)
    edges = graph.view("RENDERS").withColumn("rank", F.lit(0))
    if graph.may_lead("CALLS", "REACT_COMPONENT"):
        edges = edges.unionByName(graph.view("CALLS").withColumn("rank", F.lit(1)))
    edges = edges.join(own.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    rows = edges.select("target_id", "rank", "pos", F.col("source_id").alias("id")).join(graph.nodes, "id")
    found = rows.groupBy(F.col("target_id").alias("id")).agg(ordered_list(caller_text(), F.col("rank"), F.col("pos")).alias("callers"))
    return _with(own, found)


def hook_context(graph: Graph, of: DataFrame | None = None) -> DataFrame:
    rows, ids = _nodes(graph, "REACT_HOOK", of)
    return _with(rows, callers(graph, of=ids), callees(graph, ids))


def import_block_context(graph: Graph, imports: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Each import block with its statements, each once in their order, rebuilt where the source is missing."""
    written = S.strip(F.col("code_snippet"))
    line = F.when(F.coalesce(written, F.lit("")) != "", written).otherwise(S.import_line(F.col("type"), F.col("module"), F.col("level"), F.col("name"), F.col("alias")))
    found = imports.groupBy(F.col("block_id").alias("id")).agg(F.array_distinct(ordered_list(line, F.col("ord"))).alias("statements"))
    return _with(_nodes(graph, "IMPORT_BLOCK", of)[0], found)


def file_context(graph: Graph, of: DataFrame | None = None) -> DataFrame:
    own, ids = _nodes(graph, "FILE", of)
    inside = children(graph, ids)
    kind = F.col("node_type")
    class_text = F.when(kind == "CLASS", _named("`", F.col("name"), "`")).when(kind == "REACT_COMPONENT", _named("`", F.col("name"), "` (React Component)"))
    function_text = F.when(kind == "FUNCTION", _named("`", F.col("name"), "`")).when(kind == "REACT_HOOK", _named("`", F.col("name"), "` (React Hook)"))
    # one list of both, so a child's place is carried once
    text = F.struct(class_text.alias("c"), function_text.alias("f"))
    lists = inside.groupBy(F.col("parent").alias("id")).agg(ordered_list(text, F.col("pos")).alias("every"), F.count_if(kind == "NON_FUNCTION_NON_CLASS").alias("contained_blocks_count"))
    some = lambda part: F.filter(F.transform("every", lambda x: x[part]), lambda x: x.isNotNull())
    lists = lists.select("id", some("c").alias("contained_classes"), some("f").alias("contained_functions"), "contained_blocks_count")
    rows = own.join(lists.select("id", "contained_blocks_count"), "id", "left").fillna(0, ["contained_blocks_count"])
    return _with(rows, lists.drop("contained_blocks_count"), imports_used(graph, "IMPORTS", "imports_made", ids), summary_map(inside))


def folder_context(graph: Graph, of: DataFrame | None = None) -> DataFrame:
    """``contained_files`` has source files; text and configuration files show in the summaries only."""
    own, ids = _nodes(graph, "FOLDER", of)
    inside = children(graph, ids)
    name = _named("`", F.col("name"), "`")
    files = _gather(inside.where("node_type = 'FILE'"), "parent", name, "contained_files")
    folders = _gather(inside.where("node_type = 'FOLDER'"), "parent", name, "contained_folders")
    return _with(own, files, folders, summary_map(inside))
