"""Trees: from paths, down from the roots, and up level by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_tree(paths: DataFrame, path: str = "path", within: tuple[str, ...] = ()) -> DataFrame:
    """(path, parent, name, depth, is_file) of all files and of the folders above them; the root is ``.`` at depth 0.
    Columns ``within`` come first: each of their values has a tree of its own.

    Every file gives its prefixes, which one distinct aggregate joins; there is no recursion.
    """
    parts = F.filter(F.split(F.col(path), "/", -1), lambda p: (p != "") & (p != "."))
    rows = paths.select(*within, parts.alias("parts")).where(F.size("parts") > 0)
    steps = rows.select(*within, "parts", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("n"))
    step = steps.select(
        *within,
        F.when(F.col("n") == 0, ".").otherwise(F.array_join(F.slice("parts", 1, F.col("n")), "/")).alias("path"),
        F.when(F.col("n") == 1, ".").when(F.col("n") > 1, F.array_join(F.slice("parts", 1, F.col("n") - 1), "/")).alias("parent"),
        F.when(F.col("n") == 0, ".").otherwise(F.element_at("parts", F.greatest(F.col("n"), F.lit(1)))).alias("name"),
        F.col("n").alias("depth"),
        (F.col("n") == F.size("parts")).alias("is_file"),
    )
    return step.groupBy(*within, "path", "parent", "name", "depth").agg(F.max("is_file").alias("is_file"))


def chains(nodes: DataFrame, element: Column, depth: int | None = None) -> DataFrame:
    """The nodes with ``chain``, the elements of a node and all above it, nearest first, and ``open``: null where the chain
    ends at a root, else the parent that isn't there (or, in a cycle, the next one).

    ``nodes`` has id, unique, and belongs_to, null for roots. Chains double in each round, by one equi-join, so the plan
    grows with the depth and not with its power. ``depth``: how far below the roots the nodes lie at most; by default the
    highest ``depth`` among them, which is one aggregate.
    """
    if depth is None:
        depth = nodes.agg(F.max("depth")).first()[0] or 0
    out = nodes.withColumns({"chain": F.array(element), "open": F.col("belongs_to")})
    for _ in range(max(depth, 0).bit_length()):
        up = out.select(F.col("id").alias("__id"), F.col("open").alias("__open"), F.col("chain").alias("__chain"))
        joined = out.join(up, F.col("open") == F.col("__id"), "left")
        longer = {"chain": F.when(F.col("__id").isNull(), F.col("chain")).otherwise(F.concat("chain", "__chain")), "open": F.when(F.col("__id").isNull(), F.col("open")).otherwise(F.col("__open"))}
        out = joined.withColumns(longer).select(*out.columns)
    return out


def descend(nodes: DataFrame, key: Callable[[str], Column], depth: int | None = None) -> DataFrame:
    """Nodes with ``sort_key``, the keys of all above and itself, and ``level``: sorting by the key walks the tree from the
    root. A node that is no root's descendant, or in a cycle, is left out."""
    rows = chains(nodes, key(""), depth).where("open IS NULL")
    return rows.withColumns({"sort_key": F.reverse("chain"), "level": F.size("chain") - 1}).drop("chain", "open")


def bottom_up(nodes: DataFrame, own: Column, combine: Callable[[Column], Column], depth: int | None = None) -> DataFrame:
    """(id, depth, value): ``combine`` over the values of a node and of all below it.

    ``nodes`` has id, belongs_to and depth. ``combine`` is an aggregate that may be applied to its own results (sum, min,
    max). Each value goes to all above it, in one aggregate with map-side combining, so a root is no hot task.
    """
    rows = nodes.select("id", "belongs_to", "depth", own.alias("value"))
    spread = chains(rows, F.struct("id", "depth"), depth).select("value", F.explode(F.array_distinct("chain")).alias("c"))
    return spread.groupBy(F.col("c.id").alias("id"), F.col("c.depth").alias("depth")).agg(combine(F.col("value")).alias("value"))
