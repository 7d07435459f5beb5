"""Prompts as Column expressions: a head line that says what is asked, then the facts of a node, one labelled part each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repograph import constants as K
from repograph.functions import scalars as S

ASKED = {
    "FUNCTION": "Explain what this function does, its parameters and its result.",
    "CLASS": "Explain what this class is for and how its methods work together.",
    "NON_FUNCTION_NON_CLASS": "Explain what this top-level code does when the module is loaded.",
    "IMPORT_BLOCK": "Say in a few words what these imports are needed for.",
    "FILE": "Summarise this file from the summaries of its parts.",
    "FOLDER": "Summarise this folder from the summaries of its contents.",
    "REACT_COMPONENT": "Explain what this component shows and what it depends on.",
    "REACT_HOOK": "Explain what this hook provides and when it is used.",
    "PROJECT": "Give an overview of the project from the summaries of its top level.",
    **{kind: f"Summarise this {label} file and what it configures or tells." for kind, label in K.KIND_LABELS.items()},
}

#: The labelled parts of each prompt: label, column, and how it is shown (text, code or list).
PARTS = {
    "FUNCTION": [("File", "file_path", "text"), ("Class", "class_name", "text"), ("Access", "access_modifier", "text"), ("Signature", "signature", "text"), ("Docstring", "docstring", "text"), ("Callers", "callers", "list"), ("Callees", "callees", "list"), ("Imports used", "imports_used", "list"), ("Code", "code_snippet", "code")],
    "CLASS": [("File", "file_path", "text"), ("Signature", "signature", "text"), ("Access", "access_modifier", "text"), ("Docstring", "docstring", "text"), ("Inherits from", "inherits_from", "list"), ("Methods", "methods", "list"), ("Imports used", "imports_used", "list"), ("Code", "code_snippet", "code")],
    "NON_FUNCTION_NON_CLASS": [("File", "file_path", "text"), ("Name", "name", "text"), ("Calls made", "calls_made", "list"), ("Imports used", "imports_used", "list"), ("Code", "code_snippet", "code")],
    "IMPORT_BLOCK": [("File", "file_path", "text"), ("Statements", "statements", "list")],
    "FILE": [("File", "file_path", "text"), ("Module", "module_path", "text"), ("Classes", "contained_classes", "list"), ("Functions", "contained_functions", "list"), ("Imports", "imports_made", "list"), ("Parts", "component_summaries", "map")],
    "FOLDER": [("Folder", "file_path", "text"), ("Files", "contained_files", "list"), ("Folders", "contained_folders", "list"), ("Contents", "component_summaries", "map")],
    "REACT_COMPONENT": [("File", "file_path", "text"), ("Name", "name", "text"), ("Hooks", "hooks_used", "list"), ("Renders", "renders_components", "list"), ("Callers", "callers", "list"), ("Code", "code_snippet", "code")],
    "REACT_HOOK": [("File", "file_path", "text"), ("Name", "name", "text"), ("Signature", "signature", "text"), ("Callers", "callers", "list"), ("Callees", "callees", "list"), ("Code", "code_snippet", "code")],
    "PROJECT": [("Project", "name", "text"), ("Top level", "component_summaries", "map")],
    **{kind: [("File", "file_path", "text"), ("Content", "raw_content", "code")] for kind in K.CONFIG_KINDS},
}


def prompt(node_type: str, column=F.col) -> Column:
    """The prompt of a row of the type's context."""
    lines = [F.lit(ASKED[node_type])]
    for label, name, kind in PARTS[node_type]:
        value = column(name)
        if kind == "list":
            shown = F.concat(F.lit("\n"), S.bullet_list(value))
        elif kind == "map":
            shown = F.concat(F.lit("\n"), S.bullet_list(F.transform(value, lambda x: F.concat(x["key"], F.lit(": "), x["value"]))))
        elif kind == "code":
            language = F.lit(K.KIND_LANGUAGES[node_type]) if node_type in K.KIND_LANGUAGES else S.code_language(column("file_path"))
            shown = F.concat(F.lit("\n"), S.prompt_code(value, language))
        else:
            shown = F.concat(F.lit(" "), F.when(F.coalesce(value, F.lit("")) == "", "N/A").otherwise(value))
        lines.append(F.concat(F.lit(f"{label}:"), shown))
    return F.concat_ws("\n", *lines)
