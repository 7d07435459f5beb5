"""The graph of a set of files: nodes in the order of a walk (files before folders, by name), and structural edges.

Each project (an archive, a folder) has a tree of its own: ids and places hold its name. ``seq`` of a node is (path key,
ord): the path key is an array of (0 for a file or 1 for a folder, name), the project first and then one for each level, which
sorts as the walk goes; ``ord`` counts the nodes of a file. ``seq`` of an edge is (phase, first, n, second): the
phase in which it arises, and the places of what it arises from (``place_key``; the second where the first leaves a tie). So order is a sort key, and no step numbers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.operators.graph import Graph
from repograph.operators.hierarchy import path_tree

SEQ = "struct<path:array<struct<d:int,n:string>>,ord:int>"
EDGE = ["source_id", "target_id", "type", "label", "seq"]


@dataclass(frozen=True)
class Built:
    """A graph with what resolving its references needs."""

    graph: Graph
    imports: DataFrame  # file_id, file_seq, ord and the import's parts
    calls: DataFrame  # file_id, file_seq and the call's parts
    bases: DataFrame  # project, class_id, class_seq, ord, base_name

    def stored(self, path: str) -> Built:
        """The tables written below ``path`` and read again: files are parsed once, and the joins to come start from tables."""

        def keep(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{path}/{name}")
            return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")

        graph = Graph(keep(self.graph.nodes, "nodes"), keep(self.graph.edges, "edges"))
        return Built(graph, keep(self.imports, "imports"), keep(self.calls, "calls"), keep(self.bases, "bases"))


def node_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256)


def path_key(project: Column, path: Column, is_file: Column) -> Column:
    parts = F.filter(F.split(path, "/", -1), lambda p: (p != "") & (p != "."))
    last = F.size(parts) - 1
    kinds = F.transform(parts, lambda p, i: F.struct(F.when(is_file & (i == last), 0).otherwise(1).alias("d"), p.alias("n")))
    return F.concat(F.array(F.struct(F.lit(1).alias("d"), project.alias("n"))), kinds).cast("array<struct<d:int,n:string>>")


def place_key(seq: Column) -> Column:
    """A node's ``seq`` as a string that sorts like it, and is a fraction of its size: names hold no NUL."""
    steps = F.transform(seq["path"], lambda x: F.concat(x["d"].cast("string"), x["n"]))
    return F.concat(F.array_join(steps, "\0"), F.lit("\0\0"), F.lpad(seq["ord"].cast("string"), 10, "0"))


def edge_seq(phase: int, first: Column, n: Column, second: Column | None = None) -> Column:
    """``first`` and ``second`` are ``place_key`` of what an edge arises from."""
    second = F.lit(None) if second is None else second
    return F.struct(F.lit(phase).alias("phase"), first.cast("string").alias("first"), n.cast("int").alias("n"), second.cast("string").alias("second"))


def definition_type() -> Column:
    """The type of the edge to what defines a node, null for what has no place in a file."""
    return F.when(F.coalesce(F.col("is_method"), F.lit(False)), "METHOD_OF").when(F.col("start_line").isNotNull(), "DEFINED_IN")


def first_up() -> Column:
    """The ``seq`` of a node's first edge up to its parent; ``place`` is the node's ``place_key``."""
    return edge_seq(0, F.col("place"), F.when(definition_type().isNotNull(), 1).otherwise(2))


def build(files: DataFrame, root_name: str | None = None) -> Built:
    """From ``sources.files.parsed``. ``root_name`` is the name of the folders at the roots, by default the project's last part."""
    if "project" not in files.columns:
        files = files.withColumn("project", F.lit(""))
    project = F.col("project")
    null = lambda kind: F.lit(None).cast(kind)
    folder_id = lambda path: node_id(F.lit("FOLDER"), project, path)
    file_type = F.when(F.col("kind").isin("PYTHON", "SCRIPT"), "FILE").otherwise(F.col("kind"))
    tree = path_tree(files.select("project", "path"), within=("project",)).where("NOT is_file")
    own_name = F.lit(root_name) if root_name else F.when(project == "", ".").otherwise(F.regexp_extract(project, "([^/]*)/*$", 1))
    name = F.when(F.col("path") == ".", own_name).otherwise(F.col("name"))
    common = {
        "language": null("string"), "module_path": null("string"), "start_line": null("int"), "end_line": null("int"), "docstring": null("string"),
        "signature": null("string"), "is_method": null("boolean"), "access_modifier": null("string"), "code_snippet": null("string"), "raw_content": null("string"),
        "imports_used": null("array<string>"), "hooks_used": null("array<string>"), "renders_components": null("array<string>"), "summary": null("string"),
    }
    columns = ["id", "project", "node_type", "name", "depth", "belongs_to", "file_path", *common, "seq"]

    def rows(df: DataFrame, **own: Column) -> DataFrame:
        every = common | {"project": project} | own
        return df.select(*(every[c].alias(c) for c in columns))

    folders = rows(
        tree, id=folder_id(F.col("path")), node_type=F.lit("FOLDER"), name=name, depth=F.col("depth"), file_path=F.col("path"),
        belongs_to=F.when(F.col("parent").isNotNull(), folder_id(F.col("parent"))),
        seq=F.struct(path_key(project, F.col("path"), F.lit(False)).alias("path"), F.lit(0).alias("ord")).cast(SEQ),
    )
    parts = F.filter(F.split("path", "/", -1), lambda p: (p != "") & (p != "."))
    placed = files.withColumns({"parts": parts, "key": path_key(project, F.col("path"), F.lit(True)), "node_type": file_type})
    placed = placed.withColumns(
        {
            "file_id": node_id(F.col("node_type"), project, F.col("path")),
            "file_depth": F.size("parts"),
            "folder": F.when(F.size("parts") == 1, ".").otherwise(F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/")),
        }
    )
    file_seq = F.struct(F.col("key").alias("path"), F.lit(0).alias("ord")).cast(SEQ)
    file_nodes = rows(
        placed, id=F.col("file_id"), node_type=F.col("node_type"), name=F.element_at("parts", -1), depth=F.col("file_depth"), belongs_to=folder_id(F.col("folder")),
        file_path=F.col("path"), language=F.col("language"), module_path=F.col("module_path"), raw_content=F.col("raw_content"), seq=file_seq,
    )
    code = placed.select("project", "path", "file_id", "file_depth", "key", F.explode("nodes").alias("n"))
    code_id = lambda n: node_id(F.col("n.node_type") if n is None else F.lit("CLASS"), project, F.col("path"), F.col("n.ord") if n is None else n)
    method = F.col("n.parent") >= 0
    code_nodes = rows(
        code, id=code_id(None), node_type=F.col("n.node_type"), name=F.col("n.name"), depth=F.col("file_depth") + F.when(method, 2).otherwise(1),
        belongs_to=F.when(method, code_id(F.col("n.parent"))).otherwise(F.col("file_id")), file_path=F.col("path"), start_line=F.col("n.start_line"),
        end_line=F.col("n.end_line"), docstring=F.col("n.docstring"), signature=F.col("n.signature"), is_method=F.col("n.is_method"),
        access_modifier=F.col("n.access_modifier"), code_snippet=F.col("n.code_snippet"), imports_used=F.col("n.used"), hooks_used=F.col("n.hooks"),
        renders_components=F.col("n.tags"), seq=F.struct(F.col("key").alias("path"), (F.col("n.ord") + 1).alias("ord")).cast(SEQ),
    )
    imports = code.where("n.node_type = 'IMPORT_BLOCK'").select("path", "file_id", "key", code_id(None).alias("block_id"), F.posexplode("n.imports").alias("ord", "i"))
    nodes = folders.unionByName(file_nodes).unionByName(code_nodes)
    import_rows = imports.select("file_id", "block_id", F.struct(F.col("key").alias("path"), F.lit(0).alias("ord")).cast(SEQ).alias("file_seq"), "ord", "i.*")
    calls = placed.select("file_id", file_seq.alias("file_seq"), F.explode("calls").alias("c")).select("file_id", "file_seq", "c.*")
    bases = code.where("n.node_type = 'CLASS'").select(
        "project", code_id(None).alias("class_id"), F.struct(F.col("key").alias("path"), (F.col("n.ord") + 1).alias("ord")).cast(SEQ).alias("class_seq"), F.posexplode("n.bases").alias("ord", "base_name")
    )
    return Built(Graph(nodes, structural_edges(nodes)), import_rows, calls, bases)


def structural_edges(nodes: DataFrame) -> DataFrame:
    """Down to each node, what defines it, and up to its parent, in that order."""
    child = nodes.where("belongs_to IS NOT NULL")
    definition = definition_type()
    edge = lambda a, b, kind, n: F.struct(a.alias("source_id"), b.alias("target_id"), kind.alias("type"), F.lit(n).alias("n"))
    parent, own = F.col("belongs_to"), F.col("id")
    edges = F.array(edge(parent, own, F.lit("CONTAINS"), 0), edge(own, parent, definition, 1), edge(own, parent, F.lit("IS_PART_OF"), 2))
    rows = child.select(place_key(F.col("seq")).alias("place"), F.explode(edges).alias("e")).where("e.type IS NOT NULL")
    return rows.select("e.source_id", "e.target_id", "e.type", F.lit(None).cast("string").alias("label"), edge_seq(0, F.col("place"), F.col("e.n")).alias("seq"))
