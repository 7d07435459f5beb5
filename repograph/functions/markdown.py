"""A node's section of the document, by its type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from repograph import constants as K
from repograph.functions import scalars as S


def _map(values: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key), F.lit(default))


def node_section(level: Column, column=F.col) -> Column:
    """Markdown of a row of ``nodes`` whose heading has ``level``; null for an unknown type.

    ``imports`` (the import records of an import block), ``props`` and ``hooks_used`` are arrays or null.
    """
    lit = F.lit
    name, path, summary = column("name"), column("file_path"), S.summary_block(column("summary"))
    language = S.code_language(path)
    snippet = column("code_snippet")
    lines = F.concat(column("start_line").cast("string"), lit("-"), column("end_line").cast("string"))
    has_code = F.coalesce(snippet, lit("")) != ""
    signature = F.when(F.coalesce(column("signature"), lit("")) == "", "").otherwise(F.concat(lit("**Signature:**\n"), S.code_block(column("signature"), language)))
    folded = F.when(has_code, S.details(F.concat(lit("Code Snippet (Lines "), lines, lit(")")), S.code_block(snippet, language))).otherwise("")
    plain = F.when(has_code, F.concat(lit("**Code Snippet (Lines "), lines, lit("):**\n"), S.code_block(snippet, language))).otherwise("")
    access = S.metadata_line("Access", column("access_modifier"))
    head = lambda kind, what: S.heading(F.concat(lit(f"{kind}: "), what), level)

    method = F.coalesce(column("is_method"), lit(False))
    top = F.when((column("start_line") > 0) & (column("end_line") > 0), S.heading(F.concat(lit("Top-Level Code (Lines "), lines, lit(")")), level)).otherwise(head("Top-Level Code", name))
    code = F.when(has_code, F.concat(lit("**Code Snippet:**\n"), S.code_block(snippet, language))).otherwise("")
    written = F.array_distinct(F.filter(F.transform(column("imports"), lambda i: S.strip(i["code_snippet"])), lambda x: F.coalesce(x, lit("")) != ""))
    statements = F.when(F.coalesce(F.size(written), lit(0)) > 0, S.details(lit("Import Statements"), S.code_block(F.array_join(written, "\n"), language))).otherwise("")
    listed = lambda label, items: F.when(F.coalesce(F.size(items), lit(0)) > 0, F.concat(lit(f"- **{label}:** `"), F.array_join(items, ", "), lit("`\n"))).otherwise("")
    raw = column("raw_content")
    contents = F.when(F.coalesce(raw, lit("")) == "", "").otherwise(S.details(lit("File Contents"), S.fence(raw, _map(K.KIND_LANGUAGES, column("node_type"), ""))))

    sections = {
        "FOLDER": [head("Folder", name), S.metadata_line("Path", path), summary],
        "FILE": [head("File", path), S.metadata_line("Module Path", column("module_path")), summary],
        "CLASS": [head("Class", name), access, signature, summary, folded],
        "FUNCTION": [F.when(method, head("Method", name)).otherwise(head("Function", name)), F.when(method, access).otherwise(""), signature, summary, plain],
        "NON_FUNCTION_NON_CLASS": [top, summary, code],
        "IMPORT_BLOCK": [S.heading(F.concat(lit("Import Block (Lines "), lines, lit(")")), level), summary, statements],
        "REACT_COMPONENT": [head("React Component", name), listed("Props", column("props")), listed("Hooks Used", column("hooks_used")), summary, folded],
        "REACT_HOOK": [head("React Hook", name), signature, summary, plain],
    }
    label = _map(K.KIND_LABELS, column("node_type"), "Config File")
    config = F.concat(S.heading(F.concat(label, lit(": "), name), level), S.metadata_line("Path", path), summary, contents)
    cases = [(column("node_type") == kind, F.concat(*parts)) for kind, parts in sections.items()]
    cases.append((column("node_type").isin(*K.CONFIG_KINDS), config))
    return reduce(lambda acc, c: F.when(c[0], c[1]).otherwise(acc), reversed(cases), F.lit(None).cast("string"))
