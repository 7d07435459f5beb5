"""Schemas of the engine's tables, and a registry by name. ``seq`` may be of any type that sorts."""

from __future__ import annotations

from pyspark.sql import types as T

IMPORT = "struct<type:string,module:string,level:int,name:string,alias:string,start_line:int,end_line:int,code_snippet:string>"

TABLES = {
    "members": "path string, is_dir boolean, length bigint, content binary",
    "nodes": (
        "id string, node_type string, name string, depth int, belongs_to string, file_path string, language string, module_path string, "
        "start_line int, end_line int, docstring string, signature string, is_method boolean, access_modifier string, code_snippet string, "
        "raw_content string, imports_used array<string>, props array<string>, hooks_used array<string>, renders_components array<string>, "
        f"imports array<{IMPORT}>, summary string, seq struct<path:array<struct<d:int,n:string>>,ord:int>"
    ),
    "edges": "source_id string, target_id string, type string, label string, seq bigint",
    "edges_collapsed": "source_id string, target_id string, type string, label string, pos bigint",
    "calls": "file_path string, caller_type string, caller_name string, caller_start int, caller_end int, call_name string, line int, ord int",
    "class_bases": "class_id string, base_name string, ord int",
    "tasks": "task_id string, status string, filename string, documentation string, error string, created_at timestamp, updated_at timestamp",
    "slots": "seq int, api_key string, model_name string, rate_limited_until timestamp",
}


def lookup(name: str) -> T.StructType | None:
    """The schema of a table, whatever the case of its name; None if there is none."""
    found = TABLES.get(name.lower())
    return None if found is None else T.StructType.fromDDL(found)
