"""Graph operators: filters, joins over edges, collapsing, hierarchies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from repograph.operators import contexts, hierarchy
from repograph.operators.aggregates import ordered_text
from repograph.operators.ranking import numbered
from repograph.operators.graph import Graph, first_match, last_write, node_link_json
from repograph.plans import trade
from repograph.plans.trade import WITH_COLLAPSED, WITH_EDGES, WITH_NODES
from repograph.queries.registry import query

_long = lambda *names: [F.col(n).cast("long").alias(n) for n in names]


@query(WITH_NODES + "SELECT id, name, belongs_to, seq FROM nodes WHERE node_type = 'NATION' AND depth = 1 AND belongs_to = 'R1'")
def fl_find_nodes(t):
    return trade.graph(t).find("NATION", 1, belongs_to="R1").select("id", "name", "belongs_to", "seq")


@query(WITH_NODES + "SELECT id, name, seq FROM nodes WHERE belongs_to IS NULL")
def fl_find_nodes_null(t):
    return trade.graph(t).find(belongs_to=None, no_such_attribute=None).select("id", "name", "seq")


@query(WITH_NODES + "SELECT id, node_type, name, depth::BIGINT AS depth, belongs_to FROM nodes WHERE id = 'C7'")
def fl_point_lookup(t):
    return trade.graph(t).get("C7").select("id", "node_type", "name", *_long("depth"), "belongs_to")


@query(WITH_COLLAPSED + "SELECT c.source_id, n.id, n.name, c.pos FROM collapsed c JOIN nodes n ON n.id = c.target_id WHERE c.type = 'CALLS'")
def jn_successors(t):
    return trade.graph(t).successors("CALLS").select("source_id", "id", "name", F.col("pos.n").alias("pos"))


@query(
    WITH_COLLAPSED + "SELECT c.target_id, n.id, n.node_type, c.pos FROM collapsed c JOIN nodes n ON n.id = c.source_id "
    "WHERE c.type = 'CONTAINS' AND c.target_id IN (SELECT id FROM nodes WHERE node_type = 'NATION')"
)
def jn_predecessors(t):
    g = trade.graph(t)
    return g.predecessors("CONTAINS", of=g.find("NATION")).select("target_id", "id", "node_type", F.col("pos.n").alias("pos"))


@query(WITH_COLLAPSED + "SELECT DISTINCT target_id AS parent_id, source_id AS id FROM collapsed WHERE type = 'IS_PART_OF'")
def jn_children(t):
    return trade.graph(t).children()


@query(WITH_EDGES + "SELECT source_id, target_id, label, count(*)::BIGINT AS n FROM edges WHERE type = 'CALLS' GROUP BY ALL")
def jn_out_edges(t):
    return trade.graph(t).out_edges("CALLS").groupBy("source_id", "target_id", "label").agg(F.count("*").alias("n"))


@query(WITH_COLLAPSED + "SELECT target_id, source_id, label, pos FROM collapsed WHERE type = 'CALLS'")
def jn_in_edges(t):
    return trade.graph(t).in_edges("CALLS").select("target_id", "source_id", "label", F.col("pos.n").alias("pos"))


@query(WITH_COLLAPSED + "SELECT source_id, target_id, type, label, pos FROM collapsed")
def dm_edge_collapse(t):
    return trade.graph(t).collapsed.select("source_id", "target_id", "type", "label", F.col("pos.n").alias("pos"))


@query(
    WITH_EDGES + ", known AS (SELECT id FROM nodes WHERE node_type <> 'SUPPLIER') SELECT source_id, target_id, type, count(*)::BIGINT AS n FROM edges "
    "WHERE source_id NOT IN (SELECT id FROM known) OR target_id NOT IN (SELECT id FROM known) GROUP BY ALL"
)
def jn_ref_integrity(t):
    """Edges to suppliers, once these are no nodes."""
    g = trade.graph(t)
    return Graph(g.nodes.where("node_type <> 'SUPPLIER'"), g.edges).dangling().groupBy("source_id", "target_id", "type").agg(F.count("*").alias("n"))


@query(
    "SELECT user_id, (list(event_type ORDER BY ts DESC, event_id DESC))[1] AS event_type, (list(value ORDER BY ts DESC, event_id DESC))[1] AS value FROM events GROUP BY user_id"
)
def dm_upsert_last(t):
    rows = t.events.select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("seq"))
    return last_write(rows, ["user_id"]).select("user_id", "event_type", "value")


@query(WITH_NODES + "SELECT node_type, count(*)::BIGINT AS n FROM nodes GROUP BY node_type")
def ag_node_count(t):
    return trade.nodes(t).groupBy("node_type").agg(F.count("*").alias("n"))


@query(WITH_NODES + "SELECT max(depth)::BIGINT AS max_depth FROM nodes")
def ag_max_depth(t):
    return trade.graph(t).max_depth().select(*_long("max_depth"))


@query(
    WITH_COLLAPSED + "SELECT n.id, coalesce(o.c, 0)::BIGINT AS out_degree, coalesce(i.c, 0)::BIGINT AS in_degree FROM nodes n "
    "LEFT JOIN (SELECT source_id, count(*) AS c FROM collapsed GROUP BY 1) o ON o.source_id = n.id LEFT JOIN (SELECT target_id, count(*) AS c FROM collapsed GROUP BY 1) i ON i.target_id = n.id"
)
def gr_degree(t):
    return trade.graph(t).degrees().select("id", *_long("out_degree", "in_degree"))


@query(WITH_EDGES + "SELECT type, count(*)::BIGINT AS n, min(n) AS first, max(n) AS last FROM edges GROUP BY type")
def gr_all_edges(t):
    return trade.graph(t).edges.groupBy("type").agg(F.count("*").alias("n"), F.min("seq.n").alias("first"), F.max("seq.n").alias("last"))


@query(
    WITH_NODES + ", d AS (SELECT a.id, count(*) - 1 AS c FROM nodes a JOIN nodes r ON a.depth = 0 AND r.depth = 0 GROUP BY a.id) SELECT id, depth, value FROM ("
    "SELECT o.id, 3::BIGINT AS depth, 1::BIGINT AS value FROM nodes o WHERE depth = 3"
    " UNION ALL SELECT n.id, 2, 1 + (SELECT count(*) FROM nodes o WHERE o.belongs_to = n.id) FROM nodes n WHERE n.depth = 2"
    " UNION ALL SELECT n.id, 1, 1 + (SELECT count(*) FROM nodes c WHERE c.belongs_to = n.id) + (SELECT count(*) FROM nodes o JOIN nodes c ON o.belongs_to = c.id WHERE c.belongs_to = n.id) FROM nodes n WHERE n.depth = 1"
    " UNION ALL SELECT r.id, 0, 1 + (SELECT count(*) FROM nodes n WHERE n.belongs_to = r.id) + (SELECT count(*) FROM nodes c JOIN nodes n ON c.belongs_to = n.id WHERE n.belongs_to = r.id)"
    " + (SELECT count(*) FROM nodes o JOIN nodes c ON o.belongs_to = c.id JOIN nodes n ON c.belongs_to = n.id WHERE n.belongs_to = r.id) FROM nodes r WHERE r.depth = 0)"
)
def hi_bottom_up_count(t):
    """How many nodes each subtree has."""
    return hierarchy.bottom_up(trade.nodes(t), F.lit(1).cast("long"), F.sum, 3).select("id", *_long("depth", "value"))


@query(
    WITH_NODES + "SELECT id, depth::BIGINT AS depth, value FROM (SELECT id, 3 AS depth, seq AS value FROM nodes WHERE depth = 3"
    " UNION ALL SELECT n.id, 2, greatest(n.seq, coalesce(max(o.seq), 0)) FROM nodes n LEFT JOIN nodes o ON o.belongs_to = n.id WHERE n.depth = 2 GROUP BY n.id, n.seq"
    " UNION ALL SELECT n.id, 1, greatest(n.seq, coalesce(max(c.seq), 0), coalesce(max(o.seq), 0)) FROM nodes n LEFT JOIN nodes c ON c.belongs_to = n.id LEFT JOIN nodes o ON o.belongs_to = c.id WHERE n.depth = 1 GROUP BY n.id, n.seq"
    " UNION ALL SELECT r.id, 0, greatest(r.seq, coalesce(max(n.seq), 0), coalesce(max(c.seq), 0), coalesce(max(o.seq), 0)) FROM nodes r LEFT JOIN nodes n ON n.belongs_to = r.id"
    " LEFT JOIN nodes c ON c.belongs_to = n.id LEFT JOIN nodes o ON o.belongs_to = c.id WHERE r.depth = 0 GROUP BY r.id, r.seq)"
)
def hi_bottom_up_max(t):
    """The last place in each subtree."""
    return hierarchy.bottom_up(trade.nodes(t), F.col("seq"), F.max, 3).select("id", *_long("depth", "value"))


@query(
    "SELECT r_name AS region, string_agg('NATION: ' || n_name || ' (' || c || ')', '; ' ORDER BY n_nationkey) AS overview FROM region JOIN "
    "(SELECT n_nationkey, n_name, n_regionkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c FROM nation) ON n_regionkey = r_regionkey GROUP BY r_name"
)
def hi_overview(t):
    """What each root's children tell, in their order."""
    told = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    rows = t.nation.join(told, "n_nationkey", "left").fillna(0, ["c"]).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select("r_name", F.lit("NATION").alias("node_type"), F.col("n_name").alias("name"), F.concat(F.lit("("), "c", F.lit(")")).alias("summary"), F.col("n_nationkey").alias("pos"))
    told = contexts.summary_map(rows, "r_name")
    return told.select(F.col("id").alias("region"), F.array_join(F.transform("component_summaries", lambda x: F.concat(x["key"], F.lit(" "), x["value"])), "; ").alias("overview"))


_PATH = "regexp_extract(url, '^https?://([^?#]*)', 1)"


@query(
    f"WITH p AS (SELECT list_filter(string_split({_PATH}, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM pages), "
    "s AS (SELECT parts, unnest(range(0, len(parts) + 1)) AS n FROM p WHERE len(parts) > 0) "
    "SELECT DISTINCT CASE WHEN n = 0 THEN '.' ELSE array_to_string(parts[1:n], '/') END AS path, CASE WHEN n = 1 THEN '.' WHEN n > 1 THEN array_to_string(parts[1:n-1], '/') END AS parent, "
    "CASE WHEN n = 0 THEN '.' ELSE parts[n] END AS name, n::BIGINT AS depth FROM s"
)
def gr_path_tree(t):
    paths = t.pages.select(F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("path"))
    return hierarchy.path_tree(paths).select("path", "parent", "name", *_long("depth"))


@query(
    WITH_NODES.replace("WITH ", "WITH RECURSIVE ") + ", w AS (SELECT id, belongs_to, depth, '' || name AS k FROM nodes WHERE belongs_to IS NULL UNION ALL "
    "SELECT n.id, n.belongs_to, n.depth, w.k || '/' || n.name FROM nodes n JOIN w ON n.belongs_to = w.id) SELECT id, depth::BIGINT AS depth, k AS sort_key FROM w"
)
def gr_recursive_tree(t):
    """All nodes with the names from the root on."""
    rows = hierarchy.descend(trade.nodes(t), lambda _: F.col("name"), 3)
    return rows.select("id", *_long("depth"), F.array_join("sort_key", "/").alias("sort_key"))


@query(
    WITH_COLLAPSED + "SELECT n.id, coalesce(string_agg('`' || s.name || '` (' || s.node_type || ')', '; ' ORDER BY c.pos, c.pos_tie, s.name), '') AS callees FROM nodes n "
    "LEFT JOIN collapsed c ON c.source_id = n.id AND c.type = 'CALLS' LEFT JOIN nodes s ON s.id = c.target_id WHERE n.node_type = 'CUSTOMER' GROUP BY n.id"
)
def ag_context_function(t):
    """Each customer with whom it deals with, in the order of the first deals."""
    g = trade.graph(t)
    rows = g.find("CUSTOMER").select("id").join(contexts.callees(g), "id", "left")
    return rows.select("id", F.coalesce(F.array_join("callees", "; "), F.lit("")).alias("callees"))


@query(
    WITH_NODES + "SELECT r.id, string_agg('`' || n.name || '`', '; ' ORDER BY n.seq) AS members, count(n.id)::BIGINT AS n FROM nodes r JOIN nodes n ON n.belongs_to = r.id WHERE r.node_type = 'REGION' GROUP BY r.id"
)
def ag_context_class(t):
    inside = contexts.children(trade.graph(t)).where("node_type = 'NATION'")
    rows = inside.groupBy(F.col("parent").alias("id"))
    return rows.agg(ordered_text(F.concat(F.lit("`"), "name", F.lit("`")), "; ", F.col("pos")).alias("members"), F.count("*").alias("n"))


@query(
    WITH_NODES + "SELECT n.id, string_agg(CASE WHEN c.node_type = 'CUSTOMER' THEN '`' || c.name || '`' END, '; ' ORDER BY c.seq) AS customers, "
    "string_agg(CASE WHEN c.node_type = 'SUPPLIER' THEN '`' || c.name || '` (Supplier)' END, '; ' ORDER BY c.seq) AS suppliers, count_if(c.node_type = 'SUPPLIER')::BIGINT AS n_suppliers "
    "FROM nodes n JOIN nodes c ON c.belongs_to = n.id WHERE n.node_type = 'NATION' GROUP BY n.id"
)
def ag_context_file(t):
    """Two lists by the children's type, and a count, from one aggregate."""
    inside = contexts.children(trade.graph(t)).where("node_type IN ('CUSTOMER', 'SUPPLIER')")
    is_customer = F.col("node_type") == "CUSTOMER"
    listed = lambda name: F.when(F.size(F.col(name)) > 0, F.array_join(name, "; ")).alias(name)
    text = lambda end: F.concat(F.lit("`"), "name", F.lit("`" + end))
    some = lambda c: F.transform(F.sort_array(F.filter(F.collect_list(F.struct("pos", c.alias("v"))), lambda x: x["v"].isNotNull())), lambda x: x["v"])
    rows = inside.groupBy(F.col("parent").alias("id")).agg(
        some(F.when(is_customer, text(""))).alias("customers"), some(F.when(~is_customer, text(" (Supplier)"))).alias("suppliers"), F.count_if(~is_customer).alias("n_suppliers")
    )
    return rows.select("id", listed("customers"), listed("suppliers"), "n_suppliers")


@query(
    "WITH k AS (SELECT source AS folder, lang, doc_id, text, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS b FROM documents) "
    "SELECT folder, string_agg('TEXT_FILE: ' || f.lang || ' ' || l.doc_id, '; ' ORDER BY f.doc_id) AS summaries FROM k f JOIN k l USING (folder) WHERE f.a = 1 AND l.b = 1 AND f.lang = l.lang GROUP BY folder"
)
def ag_context_folder(t):
    """Summaries by key: the first place, the last value."""
    rows = t.documents.select("source", F.lit("TEXT_FILE").alias("node_type"), F.col("lang").alias("name"), F.col("doc_id").cast("string").alias("summary"), F.col("doc_id").alias("pos"))
    told = contexts.summary_map(rows, "source")
    return told.select(F.col("id").alias("folder"), F.array_join(F.transform("component_summaries", lambda x: F.concat(x["key"], F.lit(" "), x["value"])), "; ").alias("summaries"))


_QUOTED = lambda name, value: f"'\"{name}\":\"' || {value} || '\"'"


@query(
    WITH_COLLAPSED + f"SELECT 'node' AS kind, '{{' || {_QUOTED('id', 'id')} || ',' || {_QUOTED('node_type', 'node_type')} || ',' || {_QUOTED('name', 'name')} || ',\"depth\":' || depth || "
    f"CASE WHEN belongs_to IS NULL THEN '' ELSE ',' || {_QUOTED('belongs_to', 'belongs_to')} END || ',\"seq\":' || seq || '}}' AS json FROM nodes "
    f"UNION ALL SELECT 'link', '{{' || {_QUOTED('source', 'source_id')} || ',' || {_QUOTED('target', 'target_id')} || ',' || {_QUOTED('type', 'type')} || "
    f"CASE WHEN label IS NULL THEN '' ELSE ',' || {_QUOTED('label', 'label')} END || '}}' FROM collapsed"
)
def sk_nodes_json(t):
    """The whole graph, a line for each node and collapsed edge."""
    return node_link_json(trade.graph(t))


@query(
    "SELECT o_orderkey, 'C' || o_custkey AS target_id, 'from ' || c_mktsegment || ' import ' || c_name AS label FROM orders JOIN customer ON c_custkey = o_custkey"
)
def jn_import_resolve(t):
    """Orders name customers as imports name modules: the first of a key, unresolved ones dropped."""
    first = first_match(t.customer.withColumn("module", F.col("c_custkey")), ["module"], [F.col("c_custkey")])
    rows = t.orders.join(first, F.col("o_custkey") == F.col("module"))
    label = F.concat(F.lit("from "), "c_mktsegment", F.lit(" import "), "c_name")
    return rows.select("o_orderkey", F.concat(F.lit("C"), "o_custkey").alias("target_id"), label.alias("label"))


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def jn_first_match(t):
    return first_match(t.part.select("p_name", "p_partkey"), ["p_name"], [F.col("p_partkey")])


@query("SELECT p_name, p_partkey, p_size::BIGINT AS p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part) WHERE k = 1")
def wn_first_match(t):
    w = Window.partitionBy("p_name").orderBy("p_partkey")
    return t.part.withColumn("k", F.row_number().over(w)).where("k = 1").select("p_name", "p_partkey", *_long("p_size"))


@query("SELECT p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS k FROM part) WHERE k = 1")
def wn_last_write(t):
    return last_write(t.part.select("p_name", "p_partkey", F.col("p_partkey").alias("seq")), ["p_name"]).select("p_name", "p_partkey")


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::BIGINT AS local_rank FROM documents")
def wn_seq(t):
    """An order within each source; across them the source's name decides, so nothing numbers all rows."""
    rows = t.documents.select("doc_id", "source")
    return numbered(rows, ["source"], ["doc_id"], F.floor(F.col("doc_id") / 10_000), "local_rank")
