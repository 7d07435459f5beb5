"""Tables of a code graph made from the trade tables, with SQL for the same: files from customers, code and imports from
orders, calls from lines, a class in each file. Market segments are projects, so names recur within and across them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.operators.build import SEQ, Built, structural_edges
from repograph.operators.graph import Graph

#: A class comes after all functions of its file.
CLASS_PLACE = 1_000_000_000


def _seq(project: Column, custkey: Column, place: Column) -> Column:
    part = lambda d, n: F.struct(F.lit(d).alias("d"), n.alias("n"))
    return F.struct(F.array(part(1, project), part(0, F.lpad(custkey.cast("string"), 12, "0"))).alias("path"), place.cast("int").alias("ord")).cast(SEQ)


def _module(order: Column) -> Column:
    return F.concat(F.lit("pkg"), order % 25, F.lit(".m"), order % 40)


def files(t) -> DataFrame:
    key = F.col("c_custkey")
    script = key % 3 == 0
    stem = F.concat(F.lit("pkg"), "c_nationkey", F.lit("/m"), key % 40)
    return t.customer.select(
        "c_custkey", F.concat(F.lit("F"), key).alias("id"), F.col("c_mktsegment").alias("project"), script.alias("script"),
        F.concat(stem, F.when(script, ".jsx").otherwise(".py")).alias("file_path"), F.when(~script, F.replace(stem, F.lit("/"), F.lit("."))).alias("module_path"),
        _seq(F.col("c_mktsegment"), key, F.lit(0)).alias("seq"),
    )


def built(t) -> Built:
    null = lambda kind: F.lit(None).cast(kind)
    own = files(t)
    orders = t.orders.join(own.select("c_custkey", "project", "script", "file_path", F.col("id").alias("file_id")), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    name = F.when(F.col("script"), F.concat(F.lit("C"), key % 30)).otherwise(F.concat(F.lit("f"), key % 6))
    file_nodes = own.select(
        "id", "project", F.lit("FILE").alias("node_type"), F.element_at(F.split("file_path", "/"), -1).alias("name"), F.lit(0).alias("depth"), null("string").alias("belongs_to"),
        "file_path", "module_path", F.when(F.col("script"), "javascript").otherwise("python").alias("language"), null("int").alias("start_line"), null("boolean").alias("is_method"), null("string").alias("signature"),
        null("array<string>").alias("imports_used"), null("array<string>").alias("renders_components"), "seq",
    )
    code_nodes = orders.select(
        F.concat(F.lit("N"), key).alias("id"), "project", F.when(F.col("script"), "REACT_COMPONENT").otherwise("FUNCTION").alias("node_type"), name.alias("name"), F.lit(1).alias("depth"),
        F.col("file_id").alias("belongs_to"), "file_path", null("string").alias("module_path"), null("string").alias("language"), key.cast("int").alias("start_line"), F.lit(False).alias("is_method"), null("string").alias("signature"),
        F.when(~F.col("script"), F.array(F.concat(F.lit("f"), key % 6), F.concat(F.lit("a"), key % 4, F.lit(".x")))).alias("imports_used"),
        F.when(F.col("script"), F.array(F.concat(F.lit("C"), key * 7 % 30), F.concat(F.lit("C"), key * 11 % 45))).alias("renders_components"),
        _seq(F.col("project"), F.col("o_custkey"), key).alias("seq"),
    )
    place = F.col("c_custkey") + CLASS_PLACE
    classes = own.select(
        F.concat(F.lit("K"), "c_custkey").alias("class_id"), "c_custkey", "project", "file_path", F.col("id").alias("file_id"), _seq(F.col("project"), F.col("c_custkey"), place).alias("class_seq")
    )
    class_nodes = classes.select(
        F.col("class_id").alias("id"), "project", F.lit("CLASS").alias("node_type"), F.concat(F.lit("B"), F.col("c_custkey") % 50).alias("name"), F.lit(1).alias("depth"),
        F.col("file_id").alias("belongs_to"), "file_path", null("string").alias("module_path"), null("string").alias("language"), F.col("c_custkey").cast("int").alias("start_line"),
        null("boolean").alias("is_method"), null("string").alias("signature"), null("array<string>").alias("imports_used"), null("array<string>").alias("renders_components"), F.col("class_seq").alias("seq"),
    )
    nodes = file_nodes.unionByName(code_nodes).unionByName(class_nodes)
    whole = ~F.col("script") & (key % 4 == 0)
    module = F.when(~F.col("script"), F.when(whole, "").otherwise(_module(key)))
    path = F.concat(F.lit("pkg"), key % 25, F.lit("/m"), key % 40)
    module = F.coalesce(module, F.when(key % 2 == 0, F.concat(F.lit("../"), path)).otherwise(F.concat(F.lit("@/"), path)))
    imports = orders.select(
        "file_id", F.concat(F.lit("I"), F.col("file_id")).alias("block_id"), _seq(F.col("project"), F.col("o_custkey"), F.lit(0)).alias("file_seq"), key.cast("int").alias("ord"),
        F.when(whole, "import").otherwise("from").alias("type"), module.alias("module"), F.lit(0).alias("level"),
        F.when(F.col("script"), "*").when(whole, _module(key)).otherwise(F.concat(F.lit("f"), key % 6)).alias("name"),
        F.when(~F.col("script") & (key % 5 == 0), F.concat(F.lit("a"), key % 4)).alias("alias"), null("string").alias("code_snippet"),
    )
    lines = t.lineitem.join(orders.where("NOT script"), F.col("l_orderkey") == key)
    calls = lines.select(
        "file_id", _seq(F.col("project"), F.col("o_custkey"), F.lit(0)).alias("file_seq"), (key * 10 + F.col("l_linenumber")).cast("int").alias("ord"),
        F.lit("FUNCTION").alias("caller_type"), F.concat(F.lit("f"), key % 6).alias("caller_name"), key.cast("int").alias("caller_start"),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("f"), F.col("l_partkey") % 6)).otherwise(F.concat(F.lit("a"), F.col("l_partkey") % 4, F.lit(".f"), F.col("l_suppkey") % 6)).alias("call_name"),
    )
    bases = classes.select("project", "class_id", "class_seq", F.lit(0).alias("ord"), F.concat(F.lit("B"), F.col("c_custkey") * 3 % 60).alias("base_name"))
    return Built(Graph(nodes, structural_edges(nodes)), imports, calls, bases)


_MODULE = "'pkg' || (o_orderkey % 25) || '.m' || (o_orderkey % 40)"
#: Files, imports and functions as above, and each rule's edges: one row (source_id, target_id, label) for each that is added.
EDGES = f"""WITH files AS (
  SELECT c_custkey AS place, 'F' || c_custkey AS id, c_mktsegment AS project, c_custkey % 3 = 0 AS script, 'pkg' || c_nationkey || '/m' || (c_custkey % 40) AS stem FROM customer),
mods AS (SELECT project, replace(stem, '/', '.') AS module, arg_min(id, place) AS target_id FROM files WHERE NOT script GROUP BY ALL),
code AS (SELECT o_orderkey, 'N' || o_orderkey AS id, f.id AS file_id, f.project, f.script, f.place FROM orders JOIN files f ON place = o_custkey),
imports AS (
  SELECT c.*, CASE WHEN o_orderkey % 4 = 0 THEN 'import' ELSE 'from' END AS type, {_MODULE} AS base, 'f' || (o_orderkey % 6) AS item,
    CASE WHEN o_orderkey % 5 = 0 THEN 'a' || (o_orderkey % 4) END AS alias FROM code c WHERE NOT script),
py AS (
  SELECT file_id AS source_id, target_id, CASE WHEN type = 'from' THEN 'from ' || base || ' import ' || item ELSE alias END AS label FROM imports JOIN mods ON imports.project = mods.project AND base = module),
wanted AS (SELECT o_orderkey, file_id, project, 'pkg' || (o_orderkey % 25) || '/m' || (o_orderkey % 40) AS stem, o_orderkey % 2 = 0 AS relative FROM code WHERE script),
js AS (
  SELECT w.file_id AS source_id, arg_min(f.id, (CASE WHEN f.script THEN 0 ELSE 1 END) * 10000000000 + f.place) AS target_id, '*' AS label FROM wanted w JOIN files f
    ON f.project = w.project AND f.stem = w.stem AND (f.script OR w.relative) GROUP BY w.o_orderkey, w.file_id),
imported AS (SELECT source_id, target_id, label FROM py UNION ALL SELECT * FROM js),
pairs AS (SELECT DISTINCT source_id, target_id FROM imported),
classes AS (SELECT 'K' || place AS id, project, 'B' || (place % 50) AS name, 'B' || (place * 3 % 60) AS base FROM files),
inherits AS (SELECT a.id AS source_id, b.id AS target_id, NULL::VARCHAR AS label FROM classes a JOIN classes b ON a.project = b.project AND a.base = b.name AND a.id <> b.id),
aliases AS (
  SELECT file_id, project, coalesce(alias, CASE WHEN type = 'import' THEN base ELSE item END) AS key,
    coalesce(arg_max(base, o_orderkey) FILTER (WHERE type = 'from'), arg_max(base, o_orderkey)) AS base FROM imports GROUP BY ALL),
functions AS (SELECT file_id, 'f' || (o_orderkey % 6) AS name, 'N' || min(o_orderkey) AS target_id FROM code WHERE NOT script GROUP BY ALL),
called AS (
  SELECT c.id AS source_id, c.file_id, c.project, CASE WHEN l_partkey % 2 = 0 THEN 'f' || (l_partkey % 6) ELSE 'a' || (l_partkey % 4) END AS first,
    CASE WHEN l_partkey % 2 = 0 THEN 'f' || (l_partkey % 6) ELSE 'f' || (l_suppkey % 6) END AS wanted, l_partkey % 2 = 0 AS plain FROM lineitem JOIN code c ON o_orderkey = l_orderkey WHERE NOT script),
callees AS (
  SELECT d.source_id, coalesce(h.target_id, t.target_id) AS target_id, NULL::VARCHAR AS label FROM called d
    LEFT JOIN functions h ON d.plain AND h.file_id = d.file_id AND h.name = d.wanted
    LEFT JOIN aliases a ON a.file_id = d.file_id AND a.key = d.first LEFT JOIN mods m ON m.project = a.project AND m.module = a.base
    LEFT JOIN functions t ON t.file_id = m.target_id AND t.name = d.wanted),
calls AS (SELECT * FROM callees WHERE target_id IS NOT NULL AND target_id <> source_id),
used AS (SELECT id, file_id, 'f' || (o_orderkey % 6) AS whole, 'f' || (o_orderkey % 6) AS first FROM code WHERE NOT script
  UNION ALL SELECT id, file_id, 'a' || (o_orderkey % 4) || '.x', 'a' || (o_orderkey % 4) FROM code WHERE NOT script),
uses AS (
  SELECT DISTINCT u.id AS source_id, m.target_id, NULL::VARCHAR AS label FROM used u LEFT JOIN aliases w ON w.file_id = u.file_id AND w.key = u.whole LEFT JOIN aliases f ON f.file_id = u.file_id AND f.key = u.first
    JOIN mods m ON m.module = coalesce(w.base, f.base) AND m.project = coalesce(w.project, f.project) JOIN pairs p ON p.source_id = u.file_id AND p.target_id = m.target_id),
components AS (SELECT id, o_orderkey, place, file_id, project, 'C' || (o_orderkey % 30) AS name FROM code WHERE script),
tags AS (SELECT id, file_id, project, unnest(list_distinct(['C' || (o_orderkey * 7 % 30), 'C' || (o_orderkey * 11 % 45)])) AS tag FROM components),
shown AS (
  SELECT t.id AS source_id, arg_min(c.id, (CASE WHEN c.file_id = t.file_id OR p.target_id IS NOT NULL THEN 0 ELSE 1 END, c.place, c.o_orderkey)) AS target_id, NULL::VARCHAR AS label
    FROM tags t JOIN components c ON c.name = t.tag AND c.project = t.project LEFT JOIN pairs p ON p.source_id = t.file_id AND p.target_id = c.file_id GROUP BY t.id, t.tag),
renders AS (SELECT * FROM shown WHERE source_id <> target_id)
"""
