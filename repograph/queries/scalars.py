"""Scalar rules, fed from documents, pages and names; and documents put together from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from repograph import constants as K
from repograph.functions import markdown
from repograph.functions import scalars as S
from repograph.functions.json_preview import json_preview
from repograph.functions.prompts import ASKED, prompt
from repograph.operators import assemble
from repograph.operators.aggregates import ordered_text
from repograph.operators.summarize import fixed_summary
from repograph.queries.registry import query

_long = lambda *names: [F.col(n).cast("long").alias(n) for n in names]
_PATH = "regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1)"
_path = lambda: F.regexp_extract("url", "^https?://[^/]*/([^?#]*)", 1)
_cut = lambda c, n: f"CASE WHEN length({c}) > {n} THEN {c}[1:{n}] || chr(10) || chr(10) || '... (truncated — ' || length({c}) || ' total chars)' ELSE {c} END"


@query(f"SELECT doc_id, {_cut('text', 6000)} AS content FROM documents")
def sc_truncate(t):
    return t.documents.select("doc_id", S.truncated(F.col("text"), K.CONTENT_LIMIT).alias("content"))


@query(f"SELECT page_id, {_cut('html', 10000)} AS content FROM pages")
def sc_truncate_html(t):
    return t.pages.select("page_id", S.raw_content(F.col("html"), K.CONTENT_LIMITS["HTML_FILE"]).alias("content"))


_ODD = "[' ', '', 'a/../b', '../x', '/abs/y', 'a/./b//c', 'a/../../b', 'ok/file.py', '..', 'x/..']"


def _odd(t):
    odd = F.array(*map(F.lit, [" ", "", "a/../b", "../x", "/abs/y", "a/./b//c", "a/../../b", "ok/file.py", "..", "x/.."]))
    return t.part.select("p_partkey", F.element_at(odd, (F.col("p_partkey") % 10 + 1).cast("int")).alias("path"))


@query(f"SELECT p_partkey, [true, true, true, false, false, true, false, true, false, true][p_partkey % 10 + 1] AS safe FROM (SELECT p_partkey, {_ODD}[p_partkey % 10 + 1] AS path FROM part)")
def sc_safe_path(t):
    return _odd(t).select("p_partkey", S.safe_path(F.col("path")).alias("safe"))


@query("SELECT p_partkey, [' ', '.', 'b', '../x', '/abs/y', 'a/b/c', '../b', 'ok/file.py', '..', '.'][p_partkey % 10 + 1] AS normal FROM part")
def sc_normpath(t):
    return _odd(t).select("p_partkey", S.normal_path(F.col("path")).alias("normal"))


@query(
    "WITH p AS (SELECT p_partkey, replace(p_name, ' ', '.') || '.' || p_type AS module, (p_partkey % 5)::INTEGER AS level, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'item' END AS name FROM part), "
    "q AS (SELECT *, string_split(module, '.') AS parts FROM p) SELECT p_partkey, CASE WHEN level = 0 THEN name WHEN level > len(parts) THEN NULL "
    "ELSE array_to_string(parts[1:len(parts) - level + 1], '.') || CASE WHEN name = '' THEN '' ELSE '.' || name END END AS target FROM q"
)
def sc_relative_import(t):
    module = F.concat(F.regexp_replace("p_name", " ", "."), F.lit("."), "p_type")
    name = F.when(F.col("p_partkey") % 3 == 0, "").otherwise("item")
    return t.part.select("p_partkey", S.relative_module(module, (F.col("p_partkey") % 5).cast("int"), name).alias("target"))


@query(
    "WITH n AS (SELECT p_partkey, ['', '_', '__', '__'][p_partkey % 4 + 1] || replace(p_name, ' ', '_') || ['', '', '', '__'][p_partkey % 4 + 1] AS name FROM part) "
    "SELECT p_partkey, name, CASE WHEN name LIKE '\\_\\_%\\_\\_' ESCAPE '\\' THEN 'public' WHEN name LIKE '\\_\\_%' ESCAPE '\\' THEN 'private' WHEN name LIKE '\\_%' ESCAPE '\\' THEN 'protected' ELSE 'public' END AS access FROM n"
)
def sc_access_modifier(t):
    k = (F.col("p_partkey") % 4 + 1).cast("int")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), k)
    rows = t.part.select("p_partkey", F.concat(pick("", "_", "__", "__"), F.regexp_replace("p_name", " ", "_"), pick("", "", "", "__")).alias("name"))
    return rows.withColumn("access", S.access_modifier(F.col("name")))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, 'class ' || n_name || '(' || r_name || ', object)' AS signature, 'class ' || n_name AS script FROM nation JOIN region ON r_regionkey = n_regionkey")
def sc_signature(t):
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("array<string>")
    return rows.select(*_long("n_nationkey"), S.class_signature(F.col("n_name"), F.array("r_name", F.lit("object"))).alias("signature"), S.class_signature(F.col("n_name"), none).alias("script"))


@query(
    "WITH n AS (SELECT p_partkey, ['use', 'useX', 'App', 'help'][p_partkey % 4 + 1] || upper(p_name[1:1]) || p_name[2:] AS name, p_size > 25 AS tags FROM part) "
    "SELECT p_partkey, CASE WHEN regexp_matches(name, '^use[A-Z]') THEN 'REACT_HOOK' WHEN tags OR regexp_matches(name, '^[A-Z]') THEN 'REACT_COMPONENT' ELSE 'FUNCTION' END AS kind FROM n"
)
def sc_classify_name(t):
    first = F.element_at(F.array(*map(F.lit, ["use", "useX", "App", "help"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    name = F.concat(first, F.upper(F.left("p_name", F.lit(1))), F.substr("p_name", F.lit(2)))
    return t.part.select("p_partkey", S.classify_name(name, F.col("p_size") > 25).alias("kind"))


@query(None)
def sc_json_preview(t):
    """Whole rows as JSON, cut at 60 characters: keys in their order."""
    return t.events.select("event_id", json_preview(F.to_json(F.struct("event_id", "event_type", "props")), F.lit(60)).alias("preview"))


@query(
    f"SELECT conv_id, turn, CASE WHEN regexp_full_match(body, '\\s*') THEN '{K.EMPTY_FILE}' ELSE body END AS content FROM "
    "(SELECT conv_id, turn, CASE WHEN role = 'user' THEN '  ' ELSE text END AS body FROM conversations WHERE length(text) <= 6000)"
)
def sc_empty_sentinel(t):
    """Contents of white space only, here in place of what users say; longer ones are cut, see ``sc_truncate``."""
    rows = t.conversations.where(F.length("text") <= 6000).withColumn("body", F.when(F.col("role") == "user", "  ").otherwise(F.col("text")))
    return rows.select("conv_id", "turn", S.raw_content(F.col("body")).alias("content"))


@query("SELECT conv_id, turn, CASE WHEN role = '' THEN '' ELSE repeat('#', least(6, greatest(1, turn))::INTEGER) || ' ' || role || chr(10) || chr(10) END AS heading FROM conversations")
def sc_heading(t):
    return t.conversations.select("conv_id", "turn", S.heading(F.col("role"), F.col("turn").cast("int")).alias("heading"))


_TICKS = "'```'"
_strip = lambda c: f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"


@query(f"SELECT page_id, {_TICKS} || 'html' || chr(10) || {_strip('replace(html, ' + _TICKS + ', ' + chr(39) + '\\`\\`\\`' + chr(39) + ')')} || chr(10) || {_TICKS} || chr(10) || chr(10) AS block FROM pages")
def sc_code_block(t):
    return t.pages.select("page_id", S.code_block(F.col("html"), F.lit("html")).alias("block"))


@query(
    f"SELECT page_id, CASE regexp_extract(lower({_PATH} || ['.js', '.TSX', '.py', ''][page_id % 4 + 1]), '[^.]*$') WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' ELSE 'python' END AS lang FROM pages"
)
def sc_lang(t):
    end = F.element_at(F.array(*map(F.lit, [".js", ".TSX", ".py", ""])), (F.col("page_id") % 4 + 1).cast("int"))
    return t.pages.select("page_id", S.code_language(F.concat(_path(), end)).alias("lang"))


@query(f"SELECT doc_id, '> ' || replace({_strip('text')}, chr(10), chr(10) || '> ') || chr(10) || chr(10) AS quoted FROM documents WHERE text <> ''")
def sc_quote(t):
    return t.documents.where("text <> ''").select("doc_id", S.quote(F.col("text")).alias("quoted"))


@query(
    f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR text = '' THEN '**Summary:** (Not available)' || chr(10) || chr(10) ELSE '**Summary:**' || chr(10) || chr(10) || {_strip('text')} || chr(10) || chr(10) END AS block FROM documents"
)
def sc_summary_block(t):
    return t.documents.select("doc_id", S.summary_block(F.when(F.col("doc_id") % 3 != 0, F.col("text"))).alias("block"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '' ELSE '- **Type:** `' || p_type || '`' || chr(10) END AS line FROM part")
def sc_metadata_line(t):
    return t.part.select("p_partkey", S.metadata_line("Type", F.when(F.col("p_size") % 2 == 1, F.col("p_type"))).alias("line"))


@query("SELECT source, string_agg('  - ' || doc_id, chr(10) ORDER BY doc_id) AS bullets, 'N/A' AS none FROM documents GROUP BY source")
def sc_bullet_list(t):
    rows = t.documents.groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    text = F.transform("ids", lambda x: x.cast("string"))
    return rows.select("source", S.bullet_list(text).alias("bullets"), S.bullet_list(F.array().cast("array<string>")).alias("none"))


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'import ' || p_type ELSE 'from ' || repeat('.', (p_partkey % 3)::INTEGER) || p_brand || ' import ' || p_type END || CASE WHEN p_size > 25 THEN ' as x' ELSE '' END AS line FROM part"
)
def sc_import_line(t):
    kind = F.when(F.col("p_partkey") % 2 == 0, "import").otherwise("from")
    alias = F.when(F.col("p_size") > 25, "x")
    return t.part.select("p_partkey", S.import_line(kind, F.col("p_brand"), (F.col("p_partkey") % 3).cast("int"), F.col("p_type"), alias).alias("line"))


@query(f"SELECT doc_id, replace({_strip('text')}, {_TICKS}, '`') AS cleaned FROM documents")
def sc_summary_clean(t):
    return t.documents.select("doc_id", S.clean_summary(F.col("text")).alias("cleaned"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'Codebase Documentation' ELSE p_name END AS title FROM part")
def sc_title(t):
    heads = F.array(F.lit("## Folder: "), F.lit("# File: "), F.lit("intro\n\n### "), F.lit("no heading "))
    text = F.concat(F.element_at(heads, (F.col("p_partkey") % 4 + 1).cast("int")), "p_name", F.when(F.col("p_partkey") % 4 == 0, ".zip").otherwise(""), F.lit("\nmore\n"))
    return t.part.select("p_partkey", S.title(text).alias("title"))


@query("SELECT p_partkey, replace(replace(p_name, ' ', '_') || '_é-1.0', '/', '_') AS name FROM part")
def sc_safe_filename(t):
    return t.part.select("p_partkey", S.safe_filename(F.concat("p_name", F.lit(" é-1.0.zip"))).alias("name"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN value END AS seconds FROM events")
def sc_retry_after(t):
    message = F.when(F.col("event_type") == "error", F.concat(F.lit("limit reached, Try again in "), F.col("value").cast("string"), F.lit(" s."))).otherwise("other")
    return t.events.select("event_id", S.retry_after(message).alias("seconds"))


@query("SELECT p_partkey, least(100.0, 10 * power(2.0, p_size % 10))::DOUBLE AS seconds FROM part")
def sc_backoff(t):
    return t.part.select("p_partkey", S.backoff(F.col("p_size") % 10).alias("seconds"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(' ' || replace(p_name, ' ', ' ,, ') || ', ', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM part")
def sc_csv_list(t):
    text = F.concat(F.lit(" "), F.regexp_replace("p_name", " ", " ,, "), F.lit(", "))
    return t.part.select("p_partkey", F.array_join(S.csv_list(text), "|").alias("parts"))


@query(
    "WITH b AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN event_id WHEN 2 THEN event_id * 1024 ELSE event_id * 1048576 END::BIGINT AS n FROM events), "
    "u AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(3, floor(log2(n) / 10)) END::INTEGER AS i FROM b) "
    "SELECT event_id, CASE WHEN n = 0 THEN '0 B' ELSE regexp_replace(printf('%.1f', round(n / power(1024.0, i), 1)), '\\.0$', '') || ' ' || ['B','KB','MB','GB'][i + 1] END AS size FROM u"
)
def sc_format_bytes(t):
    k = F.col("event_id") % 4
    n = F.when(k == 0, 0).when(k == 1, F.col("event_id")).when(k == 2, F.col("event_id") * 1024).otherwise(F.col("event_id") * 1048576)
    return t.events.select("event_id", S.format_bytes(n).alias("size"))


@query("SELECT p_partkey, 'Imports (L' || p_size || '-L' || (p_size + 3) || ')' AS block, 'top_level_code_L' || p_size || '-L' || (p_size + 3) AS top FROM part")
def sc_block_name(t):
    a, b = F.col("p_size"), F.col("p_size") + 3
    return t.part.select("p_partkey", S.import_block_name(a, b).alias("block"), S.top_level_name(a, b).alias("top"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, coalesce(nullif(string_agg(s_name, ',' ORDER BY s_suppkey), ''), 'default') AS models FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_nationkey")
def sc_list_fallback(t):
    rows = t.nation.join(t.supplier.where("s_acctbal > 5000"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    names = F.transform(F.sort_array(F.collect_list(F.when(F.col("s_suppkey").isNotNull(), F.struct("s_suppkey", "s_name")))), lambda x: x["s_name"])
    return rows.groupBy(F.col("n_nationkey").cast("long").alias("n_nationkey")).agg(names.alias("l")).select("n_nationkey", F.array_join(S.list_fallback(F.col("l"), "default"), ",").alias("models"))


@query(
    "SELECT c_custkey, 'C:' || CASE WHEN length(c_name) > 20 THEN c_name[1:20] || '...' ELSE c_name END AS label, 'lightcoral' AS colour, (300 + 2 * 50)::BIGINT AS size FROM (SELECT c_custkey, c_name || repeat('x', (c_custkey % 5)::INTEGER) AS c_name FROM customer)"
)
def sc_viz_attrs(t):
    name = F.concat("c_name", F.repeat(F.lit("x"), (F.col("c_custkey") % 5).cast("int")))
    label, colour, size = S.node_style(F.lit("CLASS"), name, F.lit(2))
    return t.customer.select("c_custkey", label.alias("label"), colour.alias("colour"), size.cast("long").alias("size"))


@query(
    f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'done' WHEN doc_id % 5 = 1 THEN '{K.EMPTY_FILE_SUMMARY}' WHEN doc_id % 5 = 2 THEN '{K.EMPTY_PYTHON_SUMMARY}' WHEN doc_id % 5 = 3 THEN '{K.EMPTY_FOLDER_SUMMARY}' END AS fixed FROM documents"
)
def sc_short_circuit(t):
    k = F.col("doc_id") % 5
    kinds = F.element_at(F.array(*map(F.lit, ["FILE", "TEXT_FILE", "FILE", "FOLDER", "FOLDER"])), (k + 1).cast("int"))
    summary = F.when(k == 0, "done").when(k == 1, K.FAILED_SUMMARY)
    rows = t.documents.select("doc_id", kinds.alias("node_type"), summary.alias("summary"), F.when(k == 1, K.EMPTY_FILE).alias("raw_content"), (k == 4).alias("some"))
    return rows.select("doc_id", fixed_summary(F.col("some"), F.lit(False)).alias("fixed"))


@query(
    f"SELECT conv_id, turn, '{ASKED['TEXT_FILE']}' || chr(10) || 'File: ' || conv_id || '.txt' || chr(10) || 'Content:' || chr(10) || {_TICKS} || chr(10) || {_strip('text')} || chr(10) || {_TICKS} AS prompt FROM conversations WHERE text <> ''"
)
def sc_prompt_render(t):
    """Each turn as a file; an empty one has a fixed summary instead of a prompt."""
    rows = t.conversations.where("text <> ''").select("conv_id", "turn", F.concat("conv_id", F.lit(".txt")).alias("file_path"), F.col("text").alias("raw_content"))
    return rows.select("conv_id", "turn", prompt("TEXT_FILE").alias("prompt"))


_NO_SUMMARY = "'**Summary:** (Not available)' || chr(10) || chr(10)"
_section = lambda level, name, path, body: (
    f"repeat('#', {level}) || ' Text File: ' || {name} || chr(10) || chr(10) || '- **Path:** `' || {path} || '`' || chr(10) || {_NO_SUMMARY} || "
    f"CASE WHEN {body} = '' THEN '' ELSE '<details>' || chr(10) || '<summary>File Contents</summary>' || chr(10) || chr(10) || {_TICKS} || chr(10) || {_strip(body)} || chr(10) || {_TICKS} || chr(10) || chr(10) || '</details>' || chr(10) || chr(10) END"
)


@query(f"SELECT doc_id, {_section(3, 'doc_id || ' + chr(39) + '.txt' + chr(39), 'source || ' + chr(39) + '/' + chr(39) + ' || doc_id || ' + chr(39) + '.txt' + chr(39), _cut('text', 6000).join(['(', ')']))} AS section FROM documents")
def as_format_node(t):
    """Each document as a text file's section."""
    rows = _corpus_files(t)
    return rows.select(F.col("doc_id"), markdown.node_section(F.lit(3)).alias("section"))


def _corpus_files(t):
    null = lambda kind: F.lit(None).cast(kind)
    name = F.concat("doc_id", F.lit(".txt"))
    return t.documents.select(
        "doc_id", "source", F.lit("TEXT_FILE").alias("node_type"), name.alias("name"), F.concat("source", F.lit("/"), name).alias("file_path"), S.raw_content(F.col("text")).alias("raw_content"),
        *(null("string").alias(c) for c in ("summary", "signature", "access_modifier", "code_snippet", "module_path")), null("boolean").alias("is_method"),
        null("int").alias("start_line"), null("int").alias("end_line"), null("array<string>").alias("props"), null("array<string>").alias("hooks_used"),
        null("array<struct<code_snippet:string>>").alias("imports"),
    )


@query(
    "SELECT conv_id, '## Folder: ' || conv_id || chr(10) || chr(10) || string_agg('### ' || role || chr(10) || chr(10) || '**Summary:**' || chr(10) || chr(10) || " + _strip("text") + " || chr(10) || chr(10), '' ORDER BY turn) AS document "
    "FROM conversations WHERE text <> '' GROUP BY conv_id"
)
def as_markdown_doc(t):
    """Each conversation as a document: a heading, and a section for each turn in order."""
    section = F.concat(S.heading(F.col("role"), F.lit(3)), S.summary_block(F.col("text")))
    rows = t.conversations.where("text <> ''").groupBy("conv_id").agg(ordered_text(section, "", F.col("turn")).alias("sections"))
    return rows.select("conv_id", F.concat(S.heading(F.concat(F.lit("Folder: "), "conv_id"), F.lit(2)), "sections").alias("document"))


@query(
    "WITH d AS (SELECT source AS s, doc_id, " + _cut("text", 6000) + " AS body FROM documents) "
    "SELECT 'corpus' AS place, '## Folder: corpus' || chr(10) || chr(10) || '- **Path:** `.`' || chr(10) || " + _NO_SUMMARY + " AS section "
    "UNION ALL SELECT DISTINCT 'corpus/' || s, '### Folder: ' || s || chr(10) || chr(10) || '- **Path:** `' || s || '`' || chr(10) || " + _NO_SUMMARY + " FROM d "
    "UNION ALL SELECT 'corpus/' || s || '/' || doc_id || '.txt', " + _section(4, "doc_id || '.txt'", "s || '/' || doc_id || '.txt'", "body") + " FROM d"
)
def as_markdown_project(t):
    """The documents of a corpus as one project: folders by source, files by name; a row a section, with its place. The
    sections one after the other by place are the document, which no task holds whole."""
    files = _corpus_files(t).withColumns({"id": F.concat(F.lit("F"), "doc_id"), "belongs_to": F.concat(F.lit("D"), "source"), "depth": F.lit(2), "seq": F.col("doc_id")}).drop("doc_id")
    null = lambda c: F.lit(None).cast(files.schema[c].dataType).alias(c)
    given = {"id", "node_type", "name", "file_path", "belongs_to", "depth", "seq"}
    rest = [null(c) for c in files.columns if c not in given]
    folders = t.documents.select("source").distinct().select(
        F.concat(F.lit("D"), "source").alias("id"), F.lit("FOLDER").alias("node_type"), F.col("source").alias("name"), F.col("source").alias("file_path"),
        F.lit("ROOT").alias("belongs_to"), F.lit(1).alias("depth"), F.lit(0).cast("long").alias("seq"), *rest,
    )
    root = t.spark.range(1).select(
        F.lit("ROOT").alias("id"), F.lit("FOLDER").alias("node_type"), F.lit("corpus").alias("name"), F.lit(".").alias("file_path"), F.lit(None).cast("string").alias("belongs_to"),
        F.lit(0).alias("depth"), F.lit(0).cast("long").alias("seq"), *rest,
    )
    rows = assemble.sections(root.unionByName(folders).unionByName(files), 2)
    return rows.select(F.array_join(F.transform("sort_key", lambda k: k["name"]), "/").alias("place"), "section")
