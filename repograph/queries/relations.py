"""Filters, joins, aggregates, order, sets and tasks over the plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from repograph import constants as K
from repograph.functions import scalars as S
from repograph.operators import tasks
from repograph.operators.aggregates import ordered_distinct, ordered_list, ordered_text, sorted_set
from repograph.operators.graph import first_match
from repograph.operators.ranking import numbered
from repograph.queries.registry import query

_long = lambda *names: [F.col(n).cast("long").alias(n) for n in names]
_path = lambda: F.regexp_extract("url", "^https?://[^/]*/([^?#]*)", 1)
_PATH = "regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1)"
_GLOBS = " OR ".join(f"path GLOB '{g}'" for g in K.EXCLUDED)
#: Paths with all kinds of names, made from the part table, for the rules on names.
_FILES = ["src/{}.py", "pkg/{}/__init__.py", "__init__.py", "web/{}.test.jsx", "{}.tsx", ".hidden/{}.py", "lib/{}.min.js", "venv/{}.md", "a/Dockerfile", "{}/notes.LOG", "d/{}.YAML", "x/{}.pyc", "a/.py"]


def _files(t):
    name = F.regexp_replace("p_name", " ", "_")
    patterns = F.array(*map(F.lit, _FILES))
    return t.part.select("p_partkey", F.replace(F.element_at(patterns, (F.col("p_partkey") % len(_FILES) + 1).cast("int")), F.lit("{}"), name).alias("path"))


_FILES_SQL = "files AS (SELECT p_partkey, replace([" + ", ".join(f"'{f}'" for f in _FILES) + f"][p_partkey % {len(_FILES)} + 1], '{{}}', replace(p_name, ' ', '_')) AS path FROM part)"


@query(f"WITH {_FILES_SQL} SELECT p_partkey, path, ({_GLOBS}) AS excluded FROM files")
def fl_glob_exclude(t):
    return _files(t).withColumn("excluded", S.excluded(F.col("path")))


_EXT = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]+)$', 1))"
_KNOWN = ", ".join(f"'{e}'" for e in [K.PYTHON_EXTENSION, *K.TEXT_EXTENSIONS, *K.SCRIPT_EXTENSIONS])


@query(f"WITH {_FILES_SQL} SELECT p_partkey, path FROM files WHERE {_EXT} IN ({_KNOWN}) OR lower(regexp_extract(path, '[^/]*$')) = 'dockerfile'")
def fl_supported_ext(t):
    return _files(t).where(S.supported(F.col("path")))


@query(
    f"WITH {_FILES_SQL} SELECT p_partkey, path, CASE WHEN lower(path) LIKE '%.py' THEN 'PYTHON' WHEN {_EXT} IN ('.js','.jsx','.ts','.tsx') THEN 'SCRIPT' "
    "WHEN lower(regexp_extract(path, '[^/]*$')) = 'dockerfile' THEN 'DOCKERFILE' " + " ".join(f"WHEN {_EXT} = '{e}' THEN '{k}'" for e, k in K.KIND_BY_EXTENSION.items()) + " END AS kind FROM files"
)
def sc_file_kind(t):
    return _files(t).withColumn("kind", S.file_kind(F.col("path")))


@query(
    f"WITH {_FILES_SQL} SELECT p_partkey, path, CASE WHEN path = '__init__.py' THEN '' WHEN path LIKE '%/\\_\\_init\\_\\_.py' ESCAPE '\\' THEN replace(path[:-13], '/', '.') "
    "WHEN path LIKE '%/.py' THEN replace(path, '/', '.') WHEN path LIKE '%.py' THEN replace(path[:-4], '/', '.') END AS python_module, "
    r"replace(CASE WHEN regexp_extract(path, '[^/]*$') LIKE '_%.%' THEN regexp_replace(path, '([^/])\.[^./]+$', '\1') ELSE path END, '/', '.') AS script_module FROM files"
)
def sc_module_path(t):
    return _files(t).withColumns({"python_module": S.python_module(F.col("path")), "script_module": S.script_module(F.col("path"))})


@query("SELECT doc_id, (text <> '' AND NOT starts_with(text, '(Summary generation failed') AND NOT starts_with(text, '(Error')) AS usable FROM documents")
def fl_usable_summary(t):
    return t.documents.select("doc_id", S.usable_summary(F.col("text")).alias("usable"))


@query("SELECT d.doc_id, d.lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def jn_semi(t):
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id"), "doc_id", "left_semi")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def jn_anti(t):
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("SELECT EXISTS (SELECT 1 FROM labels WHERE toxic = 1) AS any_toxic, EXISTS (SELECT 1 FROM labels WHERE toxic = 7) AS any_other")
def ag_exists(t):
    return t.labels.agg(F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("any_toxic"), F.coalesce(F.bool_or(F.col("toxic") == 7), F.lit(False)).alias("any_other"))


_SUFFIXES = ", ".join(f"'{s}'" for s in K.MODULE_SUFFIXES)


@query(
    f"WITH f AS (SELECT page_id, {_PATH} || ['.ts', '.jsx', '/index.js'][page_id % 3 + 1] AS file FROM pages), "
    f"w AS (SELECT DISTINCT {_PATH} AS target FROM pages), c AS (SELECT target, unnest(range(1, 9)) AS k FROM w), "
    f"m AS (SELECT c.target, c.k, f.page_id FROM c JOIN f ON f.file = c.target || [{_SUFFIXES}][c.k]) "
    "SELECT target, (list(page_id ORDER BY k, page_id))[1] AS page_id FROM m GROUP BY target"
)
def jn_suffix_probe(t):
    """For each wanted path, the first file by suffix, then by place, that it stands for."""
    end = F.element_at(F.array(F.lit(".ts"), F.lit(".jsx"), F.lit("/index.js")), (F.col("page_id") % 3 + 1).cast("int"))
    files = t.pages.select("page_id", F.concat(_path(), end).alias("key"))
    wanted = t.pages.select(_path().alias("target")).distinct()
    ranked = F.array(*(F.struct(F.lit(k).alias("rank"), F.concat("target", F.lit(s)).alias("key")) for k, s in enumerate(K.MODULE_SUFFIXES)))
    probes = wanted.select("target", F.explode(ranked).alias("w")).select("target", "w.rank", "w.key")
    return first_match(probes.join(files, "key"), ["target"], [F.col("rank"), F.col("page_id")]).select("target", "page_id")


@query(
    f"WITH f AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS file FROM pages), w AS (SELECT DISTINCT regexp_extract(file, '[^/]*/[^/]*$') AS ending FROM f) "
    "SELECT w.ending, min(f.page_id) AS page_id FROM w JOIN f ON suffix(f.file, w.ending) WHERE w.ending <> '' GROUP BY w.ending"
)
def jn_endswith(t):
    """The first page whose address ends so; the last segment is the key of an equi-join, the whole ending is tested after."""
    files = t.pages.select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("file")).withColumn("last", S.file_name(F.col("file")))
    wanted = files.select(F.regexp_extract("file", "[^/]*/[^/]*$", 0).alias("ending")).where("ending <> ''").distinct().withColumn("last", S.file_name(F.col("ending")))
    return wanted.join(files, "last").where(F.col("file").endswith(F.col("ending"))).groupBy("ending").agg(F.min("page_id").alias("page_id"))


@query("SELECT a.p_partkey AS part, b.p_partkey AS same_name FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_size = b.p_size WHERE a.p_partkey <> b.p_partkey")
def jn_name_many_to_many(t):
    a = t.part.select("p_name", "p_size", F.col("p_partkey").alias("part"))
    b = t.part.select("p_name", "p_size", F.col("p_partkey").alias("same_name"))
    return a.join(b, ["p_name", "p_size"]).where("part <> same_name").select("part", "same_name")


@query(
    "WITH s AS (SELECT s_suppkey, n_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey), n AS (SELECT n_nationkey, min(s_suppkey) AS k FROM s GROUP BY 1), "
    "r AS (SELECT n_regionkey, min(s_suppkey) AS k FROM s GROUP BY 1) SELECT c_custkey, coalesce(n.k, r.k) AS s_suppkey FROM customer JOIN nation cn ON cn.n_nationkey = c_nationkey "
    "LEFT JOIN n ON n.n_nationkey = c_nationkey LEFT JOIN r ON r.n_regionkey = cn.n_regionkey WHERE coalesce(n.k, r.k) IS NOT NULL"
)
def jn_tiered_resolve(t):
    """The first supplier of the customer's nation, else of its region."""
    where = t.nation.select("n_nationkey", "n_regionkey")
    s = t.supplier.join(where, F.col("s_nationkey") == F.col("n_nationkey"))
    near = s.groupBy("n_nationkey").agg(F.min("s_suppkey").alias("near"))
    far = s.groupBy("n_regionkey").agg(F.min("s_suppkey").alias("far"))
    c = t.customer.join(where, F.col("c_nationkey") == F.col("n_nationkey")).join(near, "n_nationkey", "left").join(far, "n_regionkey", "left")
    return c.select("c_custkey", F.coalesce("near", "far").alias("s_suppkey")).where("s_suppkey IS NOT NULL")


@query(
    "WITH s AS (SELECT s_suppkey, n_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT c_custkey, s_suppkey FROM ("
    "SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY s.n_nationkey <> c_nationkey, s_suppkey) AS k FROM customer JOIN nation cn ON cn.n_nationkey = c_nationkey "
    "JOIN s ON s.n_regionkey = cn.n_regionkey) WHERE k = 1"
)
def jn_priority_pick(t):
    """One supplier of the region for each customer, one of its nation first."""
    where = t.nation.select("n_nationkey", "n_regionkey")
    s = t.supplier.join(where, F.col("s_nationkey") == F.col("n_nationkey"))
    # the first of a nation and the first of a region are all that can be picked
    firsts = s.groupBy("n_regionkey", "n_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("own")).join(where.withColumnRenamed("n_nationkey", "own"), "own")
    return first_match(c.join(firsts, "n_regionkey"), ["c_custkey"], [F.col("n_nationkey") != F.col("own"), F.col("s_suppkey")]).select("c_custkey", "s_suppkey")


@query(
    "SELECT a.l_orderkey, a.l_linenumber::BIGINT AS l_linenumber, a.n, b.n AS returned FROM (SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL) a "
    "JOIN (SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) b USING (l_orderkey, l_linenumber)"
)
def jn_composite_key(t):
    """All lines with those returned, by the two parts of their key."""
    key = ["l_orderkey", "l_linenumber"]
    every = t.lineitem.groupBy(*key).agg(F.count("*").alias("n"))
    returned = t.lineitem.where("l_returnflag = 'R'").groupBy(*key).agg(F.count("*").alias("returned"))
    return every.join(returned, key).select("l_orderkey", *_long("l_linenumber"), "n", "returned")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def jn_parent_lookup(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("c_custkey", "n_name", "r_name")


@query("SELECT r_name AS api_key, seg AS model_name, (row_number() OVER (ORDER BY r_regionkey, seg) - 1)::BIGINT AS seq FROM region, (SELECT DISTINCT c_mktsegment AS seg FROM customer)")
def jn_cross(t):
    """Every key with every model, key by key: both lists are short settings."""
    models = t.customer.select(F.col("c_mktsegment").alias("model_name")).distinct()
    return tasks.slots(t.region.select(F.col("r_name").alias("api_key"), F.col("r_regionkey").alias("place")), models)


@query("SELECT o_custkey, min(o_orderdate)::VARCHAR AS first, max(o_orderdate)::VARCHAR AS last, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY o_custkey")
def ag_min_max(t):
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    rows = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    return rows.select("o_custkey", day("a").alias("first"), day("b").alias("last"), "low", "high")


@query(
    f"WITH {_FILES_SQL}, c AS (SELECT path, ({_GLOBS}) AS excluded, ({_EXT} IN ({_KNOWN}) OR lower(regexp_extract(path, '[^/]*$')) = 'dockerfile') AS supported FROM files) "
    "SELECT count_if(excluded)::BIGINT AS excluded_files, count_if(NOT excluded AND supported)::BIGINT AS kept_files, count_if(NOT excluded AND NOT supported)::BIGINT AS unsupported_files, count(*)::BIGINT AS all_files FROM c"
)
def ag_conditional_counts(t):
    rows = _files(t).select(S.excluded(F.col("path")).alias("excluded"), S.supported(F.col("path")).alias("supported"))
    return rows.agg(
        F.count_if("excluded").alias("excluded_files"), F.count_if(F.expr("NOT excluded AND supported")).alias("kept_files"),
        F.count_if(F.expr("NOT excluded AND NOT supported")).alias("unsupported_files"), F.count("*").alias("all_files"),
    )


@query(
    "SELECT turn::BIGINT AS depth, count_if(length(text) > 300)::BIGINT AS ok, count_if(length(text) <= 300)::BIGINT AS failed FROM conversations GROUP BY turn "
    "UNION ALL SELECT NULL, count_if(length(text) > 300), count_if(length(text) <= 300) FROM conversations"
)
def ag_depth_counts(t):
    """By level, and in all."""
    ok = F.length("text") > 300
    return t.conversations.rollup(F.col("turn").alias("depth")).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), ' > ' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def ag_ordered_list(t):
    return t.conversations.groupBy("conv_id").agg(ordered_text(F.concat("role", F.lit(":"), F.length("text")), " > ", F.col("turn")).alias("turns"))


@query(
    "WITH k AS (SELECT p_brand, p_name, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY ALL) SELECT p_brand, string_agg(p_name || '=' || last, ',' ORDER BY first) AS entries FROM k GROUP BY p_brand"
)
def ag_map_last_wins(t):
    once = t.part.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("first"), F.max_by("p_partkey", "p_partkey").alias("last"))
    return once.groupBy("p_brand").agg(ordered_text(F.concat("p_name", F.lit("="), "last"), ",", F.col("first")).alias("entries"))


@query("SELECT p_name, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS ids FROM part GROUP BY p_name")
def ag_multimap(t):
    return t.part.groupBy("p_name").agg(F.array_join(ordered_list(F.col("p_partkey"), F.col("p_partkey")), ",").alias("ids"))


@query(
    "WITH k AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM k GROUP BY user_id"
)
def ag_distinct_ordered(t):
    return t.events.groupBy("user_id").agg(F.array_join(ordered_distinct(F.col("event_type"), F.col("event_id")), ",").alias("kinds"))


@query("SELECT c_nationkey::BIGINT AS c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey")
def ag_distinct_set(t):
    return t.customer.groupBy(F.col("c_nationkey").cast("long").alias("c_nationkey")).agg(F.array_join(sorted_set(F.col("c_mktsegment")), ",").alias("segments"))


@query("SELECT event_type, min(greatest(0, user_id - 50))::BIGINT AS soonest, count_if(user_id <= 50)::BIGINT AS available FROM events GROUP BY event_type")
def ag_min_wait(t):
    wait = F.greatest(F.lit(0).cast("long"), F.col("user_id") - 50)
    return t.events.groupBy("event_type").agg(F.min(wait).alias("soonest"), F.count_if(F.col("user_id") <= 50).alias("available"))


@query(
    "WITH c AS (SELECT DISTINCT source AS parent, lang AS name, 0 AS rank FROM documents UNION ALL SELECT source, doc_id || '.txt', 2 FROM documents) "
    "SELECT parent, name, (row_number() OVER (PARTITION BY parent ORDER BY rank, name))::BIGINT AS place FROM c"
)
def so_folder_children(t):
    """Folders first, then files, by name."""
    folders = t.documents.select(F.col("source").alias("parent"), F.col("lang").alias("name"), F.lit(0).alias("rank")).distinct()
    files = t.documents.select(F.col("source").alias("parent"), F.concat("doc_id", F.lit(".txt")).alias("name"), F.lit(2).alias("rank"))
    block = F.struct("rank", F.left("name", F.lit(3)).alias("start"))
    placed = numbered(folders.union(files), ["parent"], ["rank", "name"], block)
    return placed.select("parent", "name", (F.col("place") + 1).alias("place"))


@query("SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS lines FROM lineitem GROUP BY l_orderkey")
def so_line_order(t):
    """By line, ties in the order of adding."""
    text = F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey")
    return t.lineitem.groupBy("l_orderkey").agg(ordered_text(text, " ", F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("lines"))


@query(f"SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS host, string_agg({_PATH}, ' ' ORDER BY {_PATH}, page_id) AS paths FROM pages GROUP BY 1")
def so_path_order(t):
    return t.pages.groupBy(F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host")).agg(ordered_text(_path(), " ", _path(), F.col("page_id")).alias("paths"))


@query(
    "SELECT doc_id, array_to_string(w[1:5], ' ') || CASE WHEN len(w) > 5 THEN ' ... (' || (len(w) - 5) || ' more)' ELSE '' END AS preview FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)"
)
def li_topk_array(t):
    rows = t.documents.select("doc_id", F.split("text", " ", -1).alias("w"))
    more = F.when(F.size("w") > 5, F.concat(F.lit(" ... ("), F.size("w") - 5, F.lit(" more)"))).otherwise("")
    return rows.select("doc_id", F.concat(F.array_join(F.slice("w", 1, 5), " "), more).alias("preview"))


@query("SELECT user_id, (list(event_id ORDER BY event_id))[1] AS slot FROM events WHERE event_type <> 'error' GROUP BY user_id")
def li_first_available(t):
    rows = t.events.withColumn("until", F.when(F.col("event_type") == "error", F.lit(1.0)))
    return tasks.first_available(rows, ["user_id"], F.col("event_id"), F.col("until").isNull()).select("user_id", F.col("event_id").alias("slot"))


@query("SELECT 'folder' AS kind, count(*)::BIGINT AS n FROM region WHERE r_regionkey >= 0 HAVING count(*) > 0")
def st_union_fallback(t):
    """Folders, or files if there is no folder."""
    folders = t.region.where("r_regionkey >= 0").select(F.lit("folder").alias("kind"))
    files = t.nation.select(F.lit("file").alias("kind")).join(folders.limit(1).select(F.lit(1).alias("x")), F.lit(True), "left_anti")
    return folders.unionByName(files).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "SELECT c_nationkey::BIGINT AS c_nationkey, array_to_string(list_sort(list_distinct(list_concat(['BUILDING', 'legacy'], list(c_mktsegment)))), ',') AS segments FROM customer GROUP BY c_nationkey"
)
def st_array_union(t):
    own = F.array_union(F.array(F.lit("BUILDING"), F.lit("legacy")), F.collect_list("c_mktsegment"))
    return t.customer.groupBy(F.col("c_nationkey").cast("long").alias("c_nationkey")).agg(F.array_join(F.array_sort(own), ",").alias("segments"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def st_except(t):
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id")).distinct()


@query(
    "SELECT user_id AS task_id, (list(event_type ORDER BY ts DESC, event_id DESC))[1] AS status, count(*)::BIGINT AS changes FROM events "
    "WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY user_id"
)
def sm_latest_state(t):
    """A task is made by a signup; changes of tasks that were never made are ignored."""
    changes = t.events.select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), F.struct("ts", "event_id").alias("at"))
    made = t.events.where("event_type = 'signup'").select(F.col("user_id").alias("task_id")).distinct()
    return tasks.latest_state(changes, made).select("task_id", "status", "changes")


@query(
    "WITH s AS (SELECT user_id AS task_id, (list(event_type ORDER BY ts DESC, event_id DESC))[1] AS status, max(ts) AS last_ts FROM events GROUP BY user_id) "
    "SELECT task_id, status FROM s WHERE NOT (status IN ('purchase', 'error') AND date_diff('microsecond', last_ts, TIMESTAMP '2024-01-30 12:00:00') > 3600000000)"
)
def sm_ttl_evict(t):
    """Finished tasks go an hour after their last change; a purchase completes one, an error fails it."""
    changes = t.events.select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), F.struct("ts", "event_id").alias("at"))
    states = tasks.latest_state(changes).select("task_id", "status", F.col("at.ts").alias("updated_at"))
    now = F.to_timestamp_ntz(F.lit("2024-01-30 12:00:00"))
    return tasks.evicted(states, now, finished=("purchase", "error")).select("task_id", "status")
