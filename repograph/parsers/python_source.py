"""Code nodes and calls of Python source, with the standard library's syntax trees."""

from __future__ import annotations

import ast
from collections import defaultdict

from repograph.parsers import facts

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Statements that are nodes of their own when they stand outside all definitions.
_TOP_LEVEL = (
    ast.Assign, ast.AnnAssign, ast.AugAssign, ast.Expr, ast.If, ast.For, ast.While, ast.With, ast.Try, ast.Raise, ast.Assert, ast.AsyncFor, ast.AsyncWith,
)


def access(name: str) -> str:
    if name.startswith("__"):
        return "public" if name.endswith("__") else "private"
    return "protected" if name.startswith("_") else "public"


def signature(function: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """The head of a definition on one line, with `` = `` before defaults."""
    a = function.args
    text = lambda arg: arg.arg + (f": {ast.unparse(arg.annotation).strip()}" if arg.annotation else "")
    valued = lambda arg, value: text(arg) + (f" = {ast.unparse(value).strip()}" if value is not None else "")
    defaults = [None] * (len(a.args) - len(a.defaults)) + a.defaults
    # defaults of positional-only parameters are not shown
    parts = [text(x) for x in a.posonlyargs] + ["/"] * bool(a.posonlyargs)
    parts += [valued(x, d) for x, d in zip(a.args, defaults[-len(a.args) :] if a.args else [])]
    parts += [f"*{text(a.vararg)}"] if a.vararg else ["*"] * bool(a.kwonlyargs)
    parts += [valued(x, d) for x, d in zip(a.kwonlyargs, a.kw_defaults)]
    parts += [f"**{text(a.kwarg)}"] if a.kwarg else []
    result = f" -> {ast.unparse(function.returns).strip()}" if function.returns else ""
    return f"{'async ' * isinstance(function, ast.AsyncFunctionDef)}def {function.name}({', '.join(parts)}){result}"


class _Reader:
    """Goes through a tree once. ``within`` is the innermost definition or top-level statement, as (type, name, first line, last line)."""

    def __init__(self, source: str):
        self.source = source
        self.lines = len(source.splitlines())
        self.imports: list[dict] = []
        self.classes: list[tuple[ast.ClassDef, list]] = []
        self.functions: list = []
        self.top_level: list = []
        self.calls: list[dict] = []
        self.used: dict[tuple[int, int], dict[str, None]] = defaultdict(dict)

    def below(self, node: ast.AST, within, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            self.read(child, within, in_class)

    def read(self, node: ast.AST, within, in_class: bool) -> None:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            if within is None:
                self.add_imports(node)
        elif isinstance(node, ast.ClassDef):
            self.read_class(node)
        elif isinstance(node, _FUNCTIONS):
            if not in_class:  # in a class only its own methods count, which read_class takes
                self.functions.append(node)
                self.below(node, ("FUNCTION", node.name, node.lineno, node.end_lineno), False)
        elif within is None and isinstance(node, _TOP_LEVEL) and not (isinstance(node, ast.Expr) and isinstance(node.value, ast.Name)):
            self.top_level.append(node)
            self.below(node, ("TOP_LEVEL", f"top_level_code_L{node.lineno}-L{node.end_lineno}", node.lineno, node.end_lineno), in_class)
        else:
            if isinstance(node, ast.Call):
                self.add_call(node, within)
            elif within is not None and isinstance(node, (ast.Name, ast.Attribute)) and isinstance(node.ctx, ast.Load):
                self.used[within[2:]].setdefault(node.id if isinstance(node, ast.Name) else ast.unparse(node).strip())
            self.below(node, within, in_class)

    def read_class(self, node: ast.ClassDef) -> None:
        within, methods = ("CLASS", node.name, node.lineno, node.end_lineno), []
        for item in node.body:
            if isinstance(item, _FUNCTIONS):
                methods.append(item)
                self.below(item, ("FUNCTION", item.name, item.lineno, item.end_lineno), True)
            elif not isinstance(item, (ast.ClassDef, ast.Assign)):
                self.read(item, within, True)
        self.classes.append((node, methods))

    def add_imports(self, node: ast.Import | ast.ImportFrom) -> None:
        plain = isinstance(node, ast.Import)
        for name in node.names:
            self.imports.append(
                {
                    "type": "import" if plain else "from", "module": None if plain else node.module or "", "level": None if plain else node.level, "name": name.name,
                    "alias": name.asname, "start_line": node.lineno, "end_line": node.end_lineno, "code_snippet": self.text(node),
                }
            )

    def add_call(self, node: ast.Call, within) -> None:
        if isinstance(node.func, (ast.Name, ast.Attribute)):
            kind, name, first, last = within or ("FILE", None, 1, self.lines)
            called = ast.unparse(node.func).strip()
            self.calls.append({"ord": len(self.calls), "caller_type": kind, "caller_name": name, "caller_start": first, "caller_end": last, "call_name": called, "line": node.lineno})

    def text(self, node: ast.AST) -> str | None:
        return ast.get_source_segment(self.source, node)

    def nodes(self) -> list[dict]:
        """The import block, classes with their methods, functions, top-level code."""
        out: list[dict] = []

        def add(node, node_type: str, name: str, parent: int = -1, **more) -> int:
            span = (node.lineno, node.end_lineno)
            out.append(facts.node(len(out), node_type, name, *span, parent, code_snippet=self.text(node), used=list(self.used.get(span, ())), **more))
            return len(out) - 1

        def function(node, parent: int = -1) -> None:
            add(node, "FUNCTION", node.name, parent, docstring=ast.get_docstring(node), signature=signature(node), is_method=parent >= 0, access_modifier=access(node.name))

        if self.imports:
            out.append(facts.import_block(0, self.imports))
        for node, methods in self.classes:
            bases = [ast.unparse(b).strip() for b in node.bases]
            own = add(node, "CLASS", node.name, docstring=ast.get_docstring(node), signature=f"class {node.name}({', '.join(bases)})", access_modifier=access(node.name), bases=bases)
            for method in methods:
                function(method, own)
        for node in self.functions:
            function(node)
        for node in self.top_level:
            add(node, "NON_FUNCTION_NON_CLASS", f"top_level_code_L{node.lineno}-L{node.end_lineno}")
        return out


def parse(content: bytes) -> dict:
    """nodes, calls and parse_error; a file that can't be read as Python has neither nodes nor calls."""
    try:
        source = content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
        tree = ast.parse(source)
        reader = _Reader(source)
        reader.below(tree, None, False)
        return {"nodes": reader.nodes(), "calls": reader.calls, "parse_error": None}
    except (UnicodeDecodeError, SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return {"nodes": [], "calls": [], "parse_error": f"{type(e).__name__}: {e}"}
