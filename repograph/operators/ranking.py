"""Places within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, keys: list[str], order: list[str], block: Column, name: str = "place") -> DataFrame:
    """Rows with their place from 0 within ``keys`` by ``order``, without sorting a whole group in one task.

    ``block`` must not fall as ``order`` rises, and cuts a group into pieces that a task can sort. Places are those within a
    piece, and the sizes of the pieces before are added: one small row a piece, so a hot group is as spread as its pieces.
    """
    rows = rows.withColumn("__block", block)
    piece = [*keys, "__block"]
    sizes = rows.groupBy(*piece).agg(F.count("*").alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    local = rows.withColumn(name, F.row_number().over(Window.partitionBy(*piece).orderBy(*order)).cast("long") - 1)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in piece]
    joined = local.alias("a").join(sizes.alias("b"), same)
    kept = [c for c in local.columns if c not in ("__block", name)]
    return joined.select(*(F.col(f"a.{c}") for c in kept), (F.col(f"a.{name}") + F.col("b.__before")).alias(name))
