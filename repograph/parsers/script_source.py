"""Code nodes and calls of JavaScript and TypeScript source, by a reader of tokens that knows strings, templates, regular
expressions and JSX. It reads what stands at the top of a file: imports, classes, functions and functions in constants."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

from repograph.parsers import facts

_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/|/\*.*\Z)+", re.S)
_NAME = re.compile(r"#?[\w$]+")
_NUMBER = re.compile(r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?)n?")
_STRING = re.compile(r"'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_PUNCTUATION = re.compile(r"=>|\?\.(?!\d)|\.\.\.|[-+*/%&|^!=<>?:~@]=*|[-+&|<>*?]{2,3}=?|.", re.S)
_TAG = re.compile(r"<\s*([\w$.:-]*)")
_TAG_NAME = re.compile(r"[\w$.:-]+")
#: Words after which an expression begins, and words before a bracket that is no call.
_BEFORE_VALUE = {"return", "typeof", "instanceof", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "yield", "await", "default", "extends"}
_NO_CALL = {"if", "for", "while", "switch", "catch", "with", "function", "return", "typeof", "await", "yield", "new", "in", "of", "do", "else", "void", "delete", "throw", "case", "async"}
_PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Token:
    kind: str  # name, number, string, template, regex, jsx, or the mark itself
    start: int
    end: int
    partner: int = -1  # of brackets: the other one's place
    tags: list[str] = field(default_factory=list)
    inner: list[tuple[int, int]] = field(default_factory=list)  # code within templates and JSX


class Source:
    def __init__(self, text: str, jsx: bool):
        self.text, self.jsx = text, jsx
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]
        self.tokens, _ = self.read(0, None)

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1

    def word(self, t: Token) -> str:
        return self.text[t.start : t.end]

    def read(self, at: int, stop: str | None) -> tuple[list[Token], int]:
        """Tokens up to an unmatched ``stop``, and the place after it."""
        text, out, open_ = self.text, [], []
        while at < len(text):
            if m := _SPACE.match(text, at):
                at = m.end()
                continue
            c = text[at]
            if c in "'\"":
                out.append(Token("string", at, _STRING.match(text, at).end()))
            elif c == "`":
                out.append(self.template(at))
            elif c.isdigit():
                out.append(Token("number", at, _NUMBER.match(text, at).end()))
            elif m := _NAME.match(text, at):
                out.append(Token("name", at, m.end()))
            elif c == "/" and self.value_next(out) and (m := _REGEX.match(text, at)):
                out.append(Token("regex", at, m.end()))
            elif c == "<" and self.jsx and self.value_next(out) and (tag := self.element(at)):
                out.append(tag)
            else:
                if c == stop and not open_:
                    return out, at + 1
                mark = c if c in "()[]{};,." and not text.startswith(("...", "?."), at) else _PUNCTUATION.match(text, at)[0]
                out.append(Token(mark, at, at + len(mark)))
                if mark in _PAIRS:
                    open_.append(len(out) - 1)
                elif mark in ")]}" and open_:
                    k = open_.pop()
                    out[k].partner, out[-1].partner = len(out) - 1, k
            at = out[-1].end
        return out, at

    def value_next(self, before: list[Token]) -> bool:
        """Whether a value, not an operator, comes next."""
        if not before:
            return True
        last = before[-1]
        if last.kind == "name":
            return self.word(last) in _BEFORE_VALUE
        return last.kind not in ("number", "string", "template", "regex", "jsx", ")", "]", "}", "++", "--")

    def template(self, at: int) -> Token:
        token, i = Token("template", at, len(self.text)), at + 1
        while i < len(self.text):
            if self.text[i] == "\\":
                i += 2
            elif self.text[i] == "`":
                token.end = i + 1
                return token
            elif self.text.startswith("${", i):
                _, end = self.read(i + 2, "}")
                token.inner.append((i + 2, end - 1))
                i = end
            else:
                i += 1
        return token

    def element(self, at: int) -> Token | None:
        """A JSX element or fragment with all in it; None if it is none."""
        m = _TAG.match(self.text, at)
        name, i, text = m[1], m.end(), self.text
        if not name and not text.startswith(">", i):
            return None
        token = Token("jsx", at, len(text))
        if name[:1].isupper():
            token.tags.append(name)
        while True:  # attributes
            if s := _SPACE.match(text, i):
                i = s.end()
            if text.startswith("/>", i):
                token.end = i + 2
                return token
            if text.startswith(">", i):
                i += 1
                break
            if text.startswith("{", i):
                i = self.code_in(token, i)
            elif i < len(text) and text[i] in "'\"":
                quote = text.find(text[i], i + 1)
                i = len(text) if quote < 0 else quote + 1
            elif text.startswith("=", i):
                i += 1
            elif text.startswith("<", i) and (inner := self.element(i)):
                i = self.take(token, inner)
            elif a := _TAG_NAME.match(text, i):
                i = a.end()
                if a[0] == "extends":
                    return None
            else:
                return None  # a type parameter or a comparison
        while i < len(text):  # children
            if text.startswith("</", i):
                end = text.find(">", i)
                token.end = len(text) if end < 0 else end + 1
                return token
            if text.startswith("{", i):
                i = self.code_in(token, i)
            elif text.startswith("<", i) and (inner := self.element(i)):
                i = self.take(token, inner)
            else:
                i += 1
        return None

    def code_in(self, token: Token, at: int) -> int:
        _, end = self.read(at + 1, "}")
        token.inner.append((at + 1, end - 1))
        return end

    @staticmethod
    def take(token: Token, inner: Token) -> int:
        token.tags += inner.tags
        token.inner += inner.inner
        return inner.end


def _sub(source: Source, start: int, end: int) -> Source:
    """Code within a template or an element, at its own places in the text."""
    part = Source.__new__(Source)
    part.text, part.jsx, part.breaks = source.text[:end], source.jsx, source.breaks
    part.tokens, _ = part.read(start, None)
    return part


def _calls_and_tags(source: Source, tokens: list[Token]) -> tuple[list[tuple[int, int, str]], set[str]]:
    """(start, end, callee) of every call, and the capitalised tags."""
    calls, tags = [], set()
    chain: dict[int, int] = {}  # place of a token that ends an operand: where the operand starts
    for k, t in enumerate(tokens):
        before = tokens[k - 1] if k else None
        dotted = before is not None and before.kind in (".", "?.")
        if t.kind == "name":
            chain[k] = chain.get(k - 2, t.start) if dotted else t.start
        elif t.kind in ("string", "number", "regex", "template"):
            chain[k] = t.start
        elif t.kind in (")", "]") and t.partner >= 0:
            opening = t.partner
            operand = opening - 2 if opening and tokens[opening - 1].kind == "?." else opening - 1
            chain[k] = chain.get(operand, tokens[opening].start)
        if t.kind == "(" and k and t.partner >= 0:
            callee = k - 1 if before.kind != "?." else k - 2
            if callee in chain and not _no_call(source, tokens, k, callee, chain):
                end = tokens[callee].end
                calls.append((chain[callee], tokens[t.partner].end, source.text[chain[callee] : end]))
        if t.kind == "jsx":
            tags |= set(t.tags)
        for start, end in t.inner:
            part = _sub(source, start, end)
            more, inner_tags = _calls_and_tags(part, part.tokens)
            calls += more
            tags |= inner_tags
    return calls, tags


def _no_call(source: Source, tokens: list[Token], bracket: int, callee: int, chain: dict[int, int]) -> bool:
    """Whether the brackets are a statement's, a definition's or ``new``'s."""
    t = tokens[callee]
    first = next((k for k in range(callee, -1, -1) if tokens[k].start == chain[callee]), callee)
    prior = source.word(tokens[first - 1]) if first and tokens[first - 1].kind == "name" else ""
    if prior in ("new", "function"):
        return True
    if t.kind == "name" and source.word(t) in _NO_CALL and first == callee:
        return True
    closing = tokens[bracket].partner
    after = tokens[closing + 1].kind if closing + 1 < len(tokens) else ""
    if t.kind == ")" and first == callee and after == "=>":
        return True
    # a method or an object's short form: name(...) { ; an arrow's parameters
    return after == "{" and t.kind == "name" and first == callee and (first == 0 or tokens[first - 1].kind in ("{", "}", ";", ",", "*")) or after == "=>" and prior == "async"


class _Reader:
    def __init__(self, source: Source):
        self.source = source
        self.imports: list[dict] = []
        self.classes: list[dict] = []
        self.functions: list[dict] = []
        self.components: list[dict] = []
        self.hooks: list[dict] = []
        self.calls: list[dict] = []

    def word(self, k: int) -> str:
        t = self.source.tokens
        return self.source.word(t[k]) if 0 <= k < len(t) and t[k].kind == "name" else ""

    def kind(self, k: int) -> str:
        t = self.source.tokens
        return t[k].kind if 0 <= k < len(t) else ""

    def read(self) -> None:
        k = 0
        while k < len(self.source.tokens):
            k = max(k + 1, self.statement(k))

    def statement(self, k: int) -> int:
        word = self.word(k)
        if word == "export":
            k += 1
            if self.word(k) == "default":
                k += 1
                anonymous = self.word(k) in ("function", "class") and self.kind(k + 1) != "name" or self.word(k) == "async" and self.kind(k + 2) != "name"
                if anonymous or self.word(k) not in ("function", "class", "async"):
                    return self.skip(k)
            word = self.word(k)
        if word == "import" and self.kind(k + 1) not in ("(", "."):
            return self.import_(k)
        if word == "async" and self.word(k + 1) == "function":
            return self.function(k, k + 1)
        if word == "function":
            return self.function(k, k)
        if word == "class" and self.kind(k + 1) == "name":
            return self.class_(k)
        if word in ("const", "let", "var"):
            return self.constants(k)
        return self.skip(k)

    def skip(self, k: int) -> int:
        """Past a statement that is not looked into: to its end, or over its first block."""
        tokens = self.source.tokens
        while k < len(tokens):
            t = tokens[k]
            if t.kind == ";":
                return k + 1
            if t.kind in _PAIRS and t.partner > k:
                block = t.kind == "{"
                k = t.partner + 1
                if block and self.kind(k) not in (".", ",", "(", "=", "?.") and self.word(k) not in ("else", "catch", "finally", "while", "from"):
                    return k
                continue
            k += 1
            if k < len(tokens) and self.word(k) in ("import", "export", "function", "class", "const", "let", "var") and self.breaks_before(k):
                return k
        return k

    def breaks_before(self, k: int) -> bool:
        tokens = self.source.tokens
        return "\n" in self.source.text[tokens[k - 1].end : tokens[k].start]

    def import_(self, k: int) -> int:
        tokens, start = self.source.tokens, k
        while k < len(tokens) and tokens[k].kind not in ("string", ";"):
            k = tokens[k].partner + 1 if tokens[k].kind in _PAIRS and tokens[k].partner > k else k + 1
        module = ""
        end = k
        if self.kind(k) == "string":
            module = self.source.word(tokens[k]).strip("'\"")
            end = k + 1 if self.kind(k + 1) == ";" else k
        last = tokens[min(end, len(tokens) - 1)]
        span = tokens[start].start, last.end
        self.imports.append(
            {
                "type": "from", "module": module, "level": 0, "name": "*", "alias": None, "start_line": self.source.line(span[0]), "end_line": self.source.line(span[1] - 1),
                "code_snippet": self.source.text[span[0] : span[1]],
            }
        )
        return end + 1

    def body(self, k: int) -> int:
        """The place of the block that ends a function's head, from its parameters on; -1 without one."""
        tokens = self.source.tokens
        while k < len(tokens):
            if tokens[k].kind == "{" and tokens[k].partner > k:
                # a type in the head is followed by the body
                after = self.kind(tokens[k].partner + 1)
                if self.kind(k - 1) != ":" or after not in ("{", "|", "&", "["):
                    return k
                k = tokens[k].partner + 1
            elif tokens[k].kind in _PAIRS and tokens[k].partner > k:
                k = tokens[k].partner + 1
            elif tokens[k].kind == ";":
                return -1
            else:
                k += 1
        return -1

    def function(self, k: int, keyword: int) -> int:
        if self.kind(keyword + 1) != "name":  # a generator
            return self.skip(keyword + 1)
        block = self.body(keyword + 2)
        if block < 0:
            return self.skip(keyword + 2)
        end = self.source.tokens[block].partner
        self.add_function(self.word(keyword + 1), k, end)
        return end + 1

    def constants(self, k: int) -> int:
        tokens = self.source.tokens
        k += 1
        while k < len(tokens):
            name = k
            value = self.value(k)
            if value < 0:
                return self.skip(k)
            end = self.arrow_end(value) if self.is_arrow(value) else self.function_end(value)
            if end >= 0 and self.kind(name) == "name":
                self.add_function(self.word(name), value, end)
            k = self.past_value(value) if end < 0 else end + 1
            if self.kind(k) != ",":
                return k + (self.kind(k) == ";")
            k += 1
        return k

    def value(self, k: int) -> int:
        """The place after a declarator's ``=``."""
        tokens = self.source.tokens
        while k < len(tokens) and tokens[k].kind not in (";", "="):
            if tokens[k].kind == "," or k and self.breaks_before(k) and self.word(k) in ("import", "export", "function", "class", "const", "let", "var"):
                return -1
            k = tokens[k].partner + 1 if tokens[k].kind in _PAIRS and tokens[k].partner > k else k + 1
        return k + 1 if self.kind(k) == "=" else -1

    def is_arrow(self, k: int) -> bool:
        return self.arrow(k) >= 0

    def arrow(self, k: int) -> int:
        """The place of ``=>`` if an arrow function begins here."""
        tokens = self.source.tokens
        k += self.word(k) == "async" and self.kind(k + 1) in ("(", "name", "<")
        if self.kind(k) == "<":
            while k < len(tokens) and tokens[k].kind != "(":
                k += 1
        if self.kind(k) == "name" and self.kind(k + 1) == "=>":
            return k + 1
        if self.kind(k) != "(" or tokens[k].partner < 0:
            return -1
        k = tokens[k].partner + 1
        if self.kind(k) == ":":  # the result's type
            while k < len(tokens) and tokens[k].kind not in ("=>", ";", ","):
                k = tokens[k].partner + 1 if tokens[k].kind in _PAIRS and tokens[k].partner > k else k + 1
        return k if self.kind(k) == "=>" else -1

    def arrow_end(self, k: int) -> int:
        body = self.arrow(k) + 1
        if self.kind(body) == "{" and self.source.tokens[body].partner > body:
            return self.source.tokens[body].partner
        return self.past_value(body) - 1

    def function_end(self, k: int) -> int:
        k += self.word(k) == "async" and self.word(k + 1) == "function"
        if self.word(k) != "function" or self.kind(k + 1) == "*":
            return -1
        block = self.body(k + 1)
        return -1 if block < 0 else self.source.tokens[block].partner

    def past_value(self, k: int) -> int:
        """The place after an expression: a comma, a semicolon, or a line break that ends it."""
        tokens, start = self.source.tokens, k
        while k < len(tokens) and tokens[k].kind not in (",", ";", ")", "]", "}"):
            if k > start and self.breaks_before(k) and not self.source.value_next(tokens[start:k]):
                if tokens[k].kind in ("name", "string", "number", "template", "jsx", "{", "@") and self.word(k) not in ("instanceof", "in", "of", "as"):
                    return k
            k = tokens[k].partner + 1 if tokens[k].kind in _PAIRS and tokens[k].partner > k else k + 1
        return k

    def span(self, first: int, last: int) -> tuple[int, int, str]:
        start, end = self.source.tokens[first].start, self.source.tokens[last].end
        return self.source.line(start), self.source.line(end - 1), self.source.text[start:end]

    def inside(self, first: int, last: int) -> tuple[list[tuple[int, int, str]], set[str]]:
        tokens = self.source.tokens[first : last + 1]
        shifted = [Token(t.kind, t.start, t.end, t.partner - first if t.partner >= 0 else -1, t.tags, t.inner) for t in tokens]
        calls, tags = _calls_and_tags(self.source, shifted)
        return sorted(calls, key=lambda c: (c[0], -c[1])), tags

    def add_function(self, name: str, first: int, last: int) -> None:
        start, end, text = self.span(first, last)
        calls, tags = self.inside(first, last)
        row = {"name": name, "start": start, "end": end, "text": text, "tags": sorted(tags), "hooks": []}
        if name.startswith("use") and name[3:4].isupper():
            self.hooks.append(row)
        elif tags or name[:1].isupper():
            row["hooks"] = sorted({c for _, _, c in calls if c.startswith("use") and c.isidentifier()})
            self.components.append(row)
        else:
            self.functions.append(row)
        for at, _, called in calls:
            self.calls.append({"ord": len(self.calls), "caller_type": "FUNCTION", "caller_name": name, "caller_start": start, "caller_end": end, "call_name": called, "line": self.source.line(at)})

    def class_(self, k: int) -> int:
        tokens = self.source.tokens
        block = k
        while block < len(tokens) and not (tokens[block].kind == "{" and tokens[block].partner > block):
            block = tokens[block].partner + 1 if tokens[block].kind in _PAIRS and tokens[block].partner > block else block + 1
        if block >= len(tokens):
            return len(tokens)
        last = tokens[block].partner
        head = [self.word(i) for i in range(k, block)]
        start, end, text = self.span(k, last)
        row = {"name": self.word(k + 1), "start": start, "end": end, "text": text, "methods": [], "hooks": []}
        i = block + 1
        while i < last:
            i = self.member(i, last, row["methods"])
        component = any(m["name"] == "render" for m in row["methods"]) or "extends" in head and any("Component" in w for w in head[head.index("extends") :])
        if component:
            row["tags"] = sorted(self.inside(k, last)[1])
            self.components.append(row)
        else:
            self.classes.append(row)
        return last + 1

    def member(self, k: int, last: int, methods: list[dict]) -> int:
        """A method of a class body, or past what is none."""
        tokens, start = self.source.tokens, k
        while self.word(k) in ("static", "async", "get", "set", "public", "private", "protected", "override", "readonly") and self.kind(k + 1) not in ("(", "=", ";"):
            k += 1
        k += self.kind(k) == "*"
        if self.kind(k) in ("name", "string") and self.kind(k + 1) in ("(", "<"):
            block = self.body(k + 1)
            if 0 <= block < last:
                end = tokens[block].partner
                first, final, text = self.span(start, end)
                methods.append({"name": self.source.word(tokens[k]), "start": first, "end": final, "text": text})
                return end + 1
        while k < last and tokens[k].kind != ";":
            if k > start and self.breaks_before(k) and self.kind(k) == "name" and not self.source.value_next(tokens[start:k]):
                return k
            k = tokens[k].partner + 1 if tokens[k].kind in _PAIRS and tokens[k].partner > k else k + 1
        return k + 1

    def nodes(self) -> list[dict]:
        """The import block, components, hooks, classes with their methods, functions."""
        out: list[dict] = []

        def add(node_type: str, row: dict, parent: int = -1, **more) -> int:
            out.append(facts.node(len(out), node_type, row["name"], row["start"], row["end"], parent, code_snippet=row["text"], **more))
            return len(out) - 1

        if self.imports:
            out.append(facts.import_block(0, self.imports))
        for row in self.components:
            add("REACT_COMPONENT", row, hooks=row["hooks"], tags=row["tags"])
        for row in self.hooks:
            add("REACT_HOOK", row, signature=f"function {row['name']}()")
        for row in self.classes:
            own = add("CLASS", row, signature=f"class {row['name']}", access_modifier="public")
            for method in row["methods"]:
                add("FUNCTION", method, own, signature=f"{method['name']}()", is_method=True, access_modifier="public")
        for row in self.functions:
            add("FUNCTION", row, signature=f"function {row['name']}()", access_modifier="public")
        return out


def parse(content: bytes, path: str) -> dict:
    """nodes, calls and parse_error. Source that can't be made sense of gives what could."""
    text = content.decode("utf-8", "replace")
    try:
        reader = _Reader(Source(text, jsx=not path.lower().endswith(".ts")))
        reader.read()
        return {"nodes": reader.nodes(), "calls": reader.calls, "parse_error": None}
    except RecursionError as e:
        return {"nodes": [], "calls": [], "parse_error": f"{type(e).__name__}: {e}"}
