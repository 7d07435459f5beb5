"""A graph of the trade tables: regions, nations, customers and suppliers, orders; and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.operators.graph import Graph

STEP = 1_000_000_000_000


def nodes(t) -> DataFrame:
    def level(table: DataFrame, letter: str, kind: str, key: str, name, depth: int, above, place: int) -> DataFrame:
        return table.select(
            F.concat(F.lit(letter), F.col(key)).alias("id"), F.lit(kind).alias("node_type"), name.alias("name"), F.lit(depth).alias("depth"),
            (F.lit(None).cast("string") if above is None else above).alias("belongs_to"), (F.col(key).cast("long") + place * STEP).alias("seq"),
        )

    up = lambda letter, key: F.concat(F.lit(letter), F.col(key))
    rows = [
        level(t.region, "R", "REGION", "r_regionkey", F.col("r_name"), 0, None, 1),
        level(t.nation, "N", "NATION", "n_nationkey", F.col("n_name"), 1, up("R", "n_regionkey"), 2),
        level(t.customer, "C", "CUSTOMER", "c_custkey", F.col("c_name"), 2, up("N", "c_nationkey"), 3),
        level(t.supplier, "S", "SUPPLIER", "s_suppkey", F.col("s_name"), 2, up("N", "s_nationkey"), 4),
        level(t.orders, "O", "ORDER", "o_orderkey", F.col("o_orderstatus"), 3, up("C", "o_custkey"), 5),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def structure(rows: DataFrame) -> DataFrame:
    child = rows.where("belongs_to IS NOT NULL")
    pair = lambda a, b, kind, n: F.struct(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(kind).alias("type"), F.lit(n).alias("k"))
    edges = child.select("seq", F.explode(F.array(pair("belongs_to", "id", "CONTAINS", 0), pair("id", "belongs_to", "IS_PART_OF", 1))).alias("e"))
    return edges.select("e.source_id", "e.target_id", "e.type", F.lit(None).cast("string").alias("label"), F.struct((F.col("seq") * 10 + F.col("e.k")).alias("n"), F.lit("").alias("t")).alias("seq"))


def deals(t) -> DataFrame:
    """A customer calls a supplier for each line of an order; several a pair."""
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    tie = F.concat_ws("|", "l_returnflag", "l_partkey")
    place = F.lit(100 * STEP) + F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return rows.select(
        F.concat(F.lit("C"), F.col("o_custkey")).alias("source_id"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("target_id"), F.lit("CALLS").alias("type"),
        F.col("l_returnflag").alias("label"), F.struct(place.cast("long").alias("n"), tie.alias("t")).alias("seq"),
    )


def graph(t) -> Graph:
    own = nodes(t)
    return Graph(own, structure(own).unionByName(deals(t)))


NODES = f"""nodes AS (
  SELECT 'R'||r_regionkey AS id, 'REGION' AS node_type, r_name AS name, 0 AS depth, NULL::VARCHAR AS belongs_to, (r_regionkey + 1*{STEP})::BIGINT AS seq FROM region
  UNION ALL SELECT 'N'||n_nationkey, 'NATION', n_name, 1, 'R'||n_regionkey, (n_nationkey + 2*{STEP})::BIGINT FROM nation
  UNION ALL SELECT 'C'||c_custkey, 'CUSTOMER', c_name, 2, 'N'||c_nationkey, (c_custkey + 3*{STEP})::BIGINT FROM customer
  UNION ALL SELECT 'S'||s_suppkey, 'SUPPLIER', s_name, 2, 'N'||s_nationkey, (s_suppkey + 4*{STEP})::BIGINT FROM supplier
  UNION ALL SELECT 'O'||o_orderkey, 'ORDER', o_orderstatus, 3, 'C'||o_custkey, (o_orderkey + 5*{STEP})::BIGINT FROM orders)"""
EDGES = f"""edges AS (
  SELECT belongs_to AS source_id, id AS target_id, 'CONTAINS' AS type, NULL::VARCHAR AS label, seq*10 AS n, '' AS t FROM nodes WHERE belongs_to IS NOT NULL
  UNION ALL SELECT id, belongs_to, 'IS_PART_OF', NULL, seq*10+1, '' FROM nodes WHERE belongs_to IS NOT NULL
  UNION ALL SELECT 'C'||o_custkey, 'S'||l_suppkey, 'CALLS', l_returnflag, (100*{STEP} + l_orderkey*100 + l_linenumber)::BIGINT, l_returnflag||'|'||l_partkey
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
COLLAPSED = """collapsed AS (
  SELECT source_id, target_id, (list(type ORDER BY n DESC, t DESC))[1] AS type, (list(label ORDER BY n DESC, t DESC))[1] AS label, min(n) AS pos, (list(t ORDER BY n, t))[1] AS pos_tie
  FROM edges GROUP BY source_id, target_id)"""
WITH_NODES = f"WITH {NODES} "
WITH_EDGES = f"WITH {NODES}, {EDGES} "
WITH_COLLAPSED = f"WITH {NODES}, {EDGES}, {COLLAPSED} "
