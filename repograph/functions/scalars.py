"""Scalar rules as Column expressions: paths, names, truncation, Markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from repograph import constants as K

#: White space as Unicode has it; Java's ``\\s`` is ASCII only and SQL's trim takes spaces only.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"\A{SPACE}+", ""), rf"{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(text, F.lit("")).rlike(rf"\A{SPACE}*\z")


def _segments(path: Column) -> Column:
    return F.split(path, "/", -1)


# Paths


def file_name(path: Column) -> Column:
    return F.element_at(_segments(path), -1)


def extension(path: Column) -> Column:
    """The last suffix of the name with its dot, lower-cased; none for names that begin with their only dot."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)\A.+(\.[^.]+)\z", 1))


def safe_path(path: Column) -> Column:
    """Whether a member's path stays below the folder it is unpacked into."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))

    def step(acc: Column, part: Column) -> Column:
        depth = F.when(part.isin("", "."), acc["depth"]).when(part == "..", acc["depth"] - 1).otherwise(acc["depth"] + 1)
        return F.struct(depth.alias("depth"), (acc["ok"] & (depth >= 0)).alias("ok"))

    return F.coalesce(~path.startswith("/") & F.aggregate(_segments(path), zero, step, lambda a: a["ok"]), F.lit(False))


def normal_path(path: Column) -> Column:
    """POSIX normalisation: no empty or ``.`` parts, ``..`` takes back a part; ``.`` for nothing."""
    absolute = path.startswith("/")
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        back = F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.when(absolute, acc).otherwise(F.concat(acc, F.array(F.lit(".."))))
        )
        return F.when(part.isin("", "."), acc).when(part == "..", back).otherwise(F.concat(acc, F.array(part)))

    joined = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(F.aggregate(_segments(path), empty, step), "/"))
    return F.when(joined == "", ".").otherwise(joined)


def folder_of(path: Column) -> Column:
    """All before the last slash; empty without one."""
    return F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1)


def join_path(folder: Column, path: Column) -> Column:
    return F.when(path.startswith("/") | (folder == ""), path).otherwise(F.concat(F.regexp_replace(folder, r"/\z", ""), F.lit("/"), path))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression over the whole string; ``*`` crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]")
            i = end + 1
        else:
            out.append(c if c.isalnum() or c == "_" else "\\" + c if c.isascii() else c)
    return r"(?s)\A" + "".join(out) + r"\z"


def matches_any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(glob_regex(p)) for p in patterns), F.lit(False))


def excluded(path: Column, is_folder: Column | None = None, patterns: list[str] | None = None) -> Column:
    """Whether a member is left out; a folder's path is also tried with a slash after it."""
    patterns = K.EXCLUDED if patterns is None else patterns
    plain = F.regexp_replace(path, r"/\z", "")
    out = matches_any(plain, patterns)
    return out if is_folder is None else out | (is_folder & matches_any(F.concat(plain, F.lit("/")), patterns))


def supported(path: Column) -> Column:
    """Whether a file is read at all: by extension, or by its whole name."""
    known = [K.PYTHON_EXTENSION, *K.TEXT_EXTENSIONS, *K.SCRIPT_EXTENSIONS]
    return extension(path).isin(*known) | F.lower(file_name(path)).isin(*K.KNOWN_FILENAMES)


def config_kind(path: Column) -> Column:
    """The node type of a text or configuration file, or null."""
    by_name, by_extension = (F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) for m in (K.KIND_BY_FILENAME, K.KIND_BY_EXTENSION))
    return F.coalesce(F.try_element_at(by_name, F.lower(file_name(path))), F.try_element_at(by_extension, extension(path)))


def file_kind(path: Column) -> Column:
    """``PYTHON`` by the name's end, ``SCRIPT`` by extension, a configuration node type, or null to skip."""
    return F.when(F.lower(file_name(path)).endswith(K.PYTHON_EXTENSION), "PYTHON").when(extension(path).isin(*K.SCRIPT_EXTENSIONS), "SCRIPT").otherwise(config_kind(path))


# Modules and names


def python_module(path: Column) -> Column:
    """``a/b.py`` is ``a.b``, a package its folder, the root package empty; null for other files."""
    bare = F.when(file_name(path) == "__init__.py", folder_of(path)).otherwise(F.regexp_replace(path, r"(?<=[^/])\.py\z", ""))
    return F.when(path.endswith(".py"), F.replace(bare, F.lit("/"), F.lit(".")))


def script_module(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"(?<=[^/])\.[^./]+\z", ""), F.lit("/"), F.lit("."))


def relative_module(module: Column, level: Column, name: Column, strict: bool = False) -> Column:
    """What a relative import names. Level 1 keeps the importing module itself, as code in a package's own file has it;
    ``strict`` takes it off, as the language does for plain modules. Null if there are too few parts."""
    own = F.split(module, r"\.", -1)
    keep = F.size(own) - level + (0 if strict else 1)
    base = F.slice(own, 1, F.greatest(keep, F.lit(0)))
    parts = F.when(F.coalesce(name, F.lit("")) == "", base).otherwise(F.concat(base, F.array(name)))
    return F.when(level == 0, name).when(level > F.size(own), F.lit(None)).otherwise(F.array_join(parts, "."))


def access_modifier(name: Column) -> Column:
    return (
        F.when(name.startswith("__") & name.endswith("__"), "public").when(name.startswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public")
    )


def class_signature(name: Column, bases: Column) -> Column:
    """With the bases in brackets; null bases: a script's class, without brackets."""
    return F.concat(F.lit("class "), name, F.when(bases.isNull(), "").otherwise(F.concat(F.lit("("), F.array_join(bases, ", "), F.lit(")"))))


def classify_name(name: Column, has_tags: Column) -> Column:
    """A script function is a hook by its name, else a component by its tags or its capital, else a function."""
    return F.when(name.rlike(r"\Ause\p{Lu}"), "REACT_HOOK").when(has_tags | name.rlike(r"\A\p{Lu}"), "REACT_COMPONENT").otherwise("FUNCTION")


def import_block_name(first: Column, last: Column) -> Column:
    return F.format_string("Imports (L%d-L%d)", first, last)


def top_level_name(first: Column, last: Column) -> Column:
    return F.format_string("top_level_code_L%d-L%d", first, last)


# Content


def truncated(text: Column, limit: int) -> Column:
    """Cut at ``limit`` characters, with a mark that tells how many there were."""
    mark = F.concat(F.lit("\n\n... (truncated — "), F.length(text).cast("string"), F.lit(" total chars)"))
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), mark)).otherwise(text)


def raw_content(text: Column, limit: int = K.CONTENT_LIMIT) -> Column:
    """A text file's content as a node keeps it; null stays null, blank is a sentence."""
    return F.when(text.isNotNull() & is_blank(text), K.EMPTY_FILE).otherwise(truncated(text, limit))


# Markdown


def heading(text: Column, level: Column) -> Column:
    marks = F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(1), level)))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(marks, F.lit(" "), text, F.lit("\n\n")))


def code_language(path: Column) -> Column:
    last = F.element_at(F.split(F.lower(F.coalesce(path, F.lit(""))), r"\.", -1), -1)
    return F.when(last.isin("js", "jsx"), "javascript").when(last.isin("ts", "tsx"), "typescript").otherwise("python")


def fence(code: Column, language: Column) -> Column:
    return F.concat(F.lit("```"), language, F.lit("\n"), strip(code), F.lit("\n```\n\n"))


def code_block(code: Column, language: Column) -> Column:
    safe = F.replace(code, F.lit("```"), F.lit("\\`\\`\\`"))
    return F.when(F.coalesce(code, F.lit("")) == "", "").otherwise(fence(safe, language))


def quote(text: Column) -> Column:
    """A docstring as a block quote."""
    lines = F.concat(F.lit("> "), F.regexp_replace(strip(text), "\r\n|\r|\n", "\n> "), F.lit("\n\n"))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(lines)


def summary_block(summary: Column) -> Column:
    none = F.coalesce(summary, F.lit("")) == ""
    return F.when(none, "**Summary:** (Not available)\n\n").otherwise(F.concat(F.lit("**Summary:**\n\n"), strip(summary), F.lit("\n\n")))


def metadata_line(key: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.concat(F.lit(f"- **{key}:** `"), value, F.lit("`\n")))


def details(title: Column, body: Column) -> Column:
    return F.concat(F.lit("<details>\n<summary>"), title, F.lit("</summary>\n\n"), body, F.lit("</details>\n\n"))


def bullet_list(items: Column, default: str = "N/A") -> Column:
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), x)), "\n")
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, default).otherwise(lines)


def prompt_code(code: Column, language: Column) -> Column:
    none = F.coalesce(code, F.lit("")) == ""
    return F.when(none, "  N/A").otherwise(F.concat(F.lit("```"), language, F.lit("\n"), strip(code), F.lit("\n```")))


def import_line(kind: Column, module: Column, level: Column, name: Column, alias: Column) -> Column:
    """An import statement from its parts."""
    renamed = F.when(F.coalesce(alias, F.lit("")) == "", "").otherwise(F.concat(F.lit(" as "), alias))
    source = F.concat(F.repeat(F.lit("."), F.coalesce(level, F.lit(0))), F.coalesce(module, F.lit("")))
    return F.when(kind == "from", F.concat(F.lit("from "), source, F.lit(" import "), name, renamed)).otherwise(F.concat(F.lit("import "), name, renamed))


def clean_summary(text: Column) -> Column:
    return F.replace(strip(text), F.lit("```"), F.lit("`"))


def usable_summary(summary: Column) -> Column:
    failed = reduce(lambda a, b: a | b, (summary.startswith(p) for p in K.FAILED_PREFIXES))
    return F.coalesce((summary != "") & ~failed, F.lit(False))


def title(markdown: Column, default: str = "Codebase Documentation") -> Column:
    """The text of the first heading, without the kind before it and the archive's suffix after it."""
    found = strip(F.regexp_extract(markdown, r"(?md)^#{1,6}\s+(?:Folder:|File:)?\s*(.+?)(?:\.zip)?\s*$", 1))
    return F.when(F.coalesce(found, F.lit("")) == "", default).otherwise(found)


def safe_filename(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(name, r"\.zip\z", ""), r"\.ZIP\z", "")
    return F.regexp_replace(bare, r"[^\p{L}\p{N}_.\-]", "_")


# Numbers


def retry_after(message: Column) -> Column:
    """The seconds that a provider's message says to wait, or null."""
    return F.regexp_extract(message, r"(?i)try again in ([0-9]+(?:\.[0-9]+)?)\s*s", 1).try_cast("double")


def backoff(attempt: Column) -> Column:
    """Seconds before the next attempt, from 0: doubling, with a limit."""
    return F.least(F.lit(float(K.BACKOFF_LIMIT)), K.BACKOFF_START * F.pow(F.lit(2.0), attempt))


def csv_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ",", -1), strip), lambda x: x != "")


def list_fallback(items: Column, default: str) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, items).otherwise(F.array(F.lit(default)))


def format_bytes(n: Column) -> Column:
    """In powers of 1024 with one decimal, which goes if it is zero."""
    units = ["B", "KB", "MB", "GB"]
    power = F.least(F.lit(len(units) - 1), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) / 10)).cast("int")
    value = F.round(n.cast("double") / F.pow(F.lit(1024.0), power), 1)
    number = F.regexp_replace(F.format_string("%.1f", value), r"\.0\z", "")
    return F.when(n == 0, "0 B").otherwise(F.concat(number, F.lit(" "), F.element_at(F.array(*map(F.lit, units)), power + 1)))


def short_label(name: Column, most: int = 20) -> Column:
    return F.when(F.length(name) > most, F.concat(F.left(name, F.lit(most)), F.lit("..."))).otherwise(name)


def slot_text(key: Column, model: Column, wait: Column) -> Column:
    """A slot in the status: its model, the end of its key, and whether it is free or how long it waits; null wait: free."""
    state = F.when(F.coalesce(wait, F.lit(0.0)) <= 0, "available").otherwise(F.format_string("limited (%.0fs)", wait))
    return F.concat(F.lit("Slot("), model, F.lit(", key=…"), F.right(key, F.lit(6)), F.lit(", "), state, F.lit(")"))


NODE_COLOURS = {
    "FOLDER": "skyblue", "FILE": "lightgreen", "IMPORT_BLOCK": "palegreen", "CLASS": "lightcoral", "FUNCTION": "orange",
    "NON_FUNCTION_NON_CLASS": "mediumpurple",
}


def node_style(node_type: Column, name: Column, depth: Column) -> tuple[Column, Column, Column]:
    """How a node is drawn: label, colour, size."""
    colours = F.create_map(*(F.lit(x) for kv in NODE_COLOURS.items() for x in kv))
    label = F.concat(F.left(node_type, F.lit(1)), F.lit(":"), short_label(name))
    return label, F.coalesce(F.try_element_at(colours, node_type), F.lit("grey")), 300 + depth * 50
