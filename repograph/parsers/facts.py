"""What a parser tells of one file: its code nodes and calls, as nested rows."""

from __future__ import annotations

from repograph.schema import IMPORT

#: ``parent`` is the ``ord`` of the class that a method belongs to, else -1: the file.
NODE = (
    "struct<ord:int,parent:int,node_type:string,name:string,start_line:int,end_line:int,docstring:string,signature:string,is_method:boolean,"
    "access_modifier:string,code_snippet:string,used:array<string>,hooks:array<string>,tags:array<string>,bases:array<string>,"
    f"imports:array<{IMPORT}>>"
)
CALL = "struct<ord:int,caller_type:string,caller_name:string,caller_start:int,caller_end:int,call_name:string,line:int>"
FACTS = f"nodes array<{NODE}>, calls array<{CALL}>, parse_error string"


def node(ord_: int, node_type: str, name: str, start: int, end: int, parent: int = -1, **more) -> dict:
    row = {
        "ord": ord_, "parent": parent, "node_type": node_type, "name": name, "start_line": start, "end_line": end, "docstring": None, "signature": None,
        "is_method": False if node_type == "FUNCTION" else None, "access_modifier": None, "code_snippet": None, "used": [], "hooks": [], "tags": [], "bases": [], "imports": [],
    }
    return row | more


def import_block(ord_: int, imports: list[dict]) -> dict:
    first, last = min(i["start_line"] for i in imports), max(i["end_line"] for i in imports)
    return node(ord_, "IMPORT_BLOCK", f"Imports (L{first}-L{last})", first, last, imports=imports)
