import fnmatch
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repograph import constants as K
from repograph import schema
from repograph.functions import json_preview
from repograph.functions import scalars as S
from repograph.operators import tasks


@settings(max_examples=300, deadline=None)
@given(st.text("ab*?[]!^-./\\", max_size=6), st.text("ab-./]^!\\", max_size=6))
def test_globs_are_those_of_the_standard_library(pattern, text):
    if "[" in pattern and "]" in pattern[pattern.index("[") + 1 :]:
        return  # sets are compared below
    own = re.compile(S.glob_regex(pattern).replace(r"\z", r"\Z"))
    assert bool(own.match(text)) == fnmatch.fnmatchcase(text, pattern)


def test_sets_in_globs():
    for pattern, text in [("[ab]c", "bc"), ("[!ab]c", "bc"), ("[!ab]c", "xc"), ("[a-c].py", "b.py"), ("[]]", "]"), ("[", "[")]:
        own = re.compile(S.glob_regex(pattern).replace(r"\z", r"\Z"))
        assert bool(own.match(text)) == fnmatch.fnmatchcase(text, pattern), pattern


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(S.heading(F.lit("x"), F.lit(9))) == "###### x\n\n" and value(S.heading(F.lit(None).cast("string"), F.lit(1))) == ""
    assert value(S.quote(F.lit(" a\r\nb\n"))) == "> a\n> b\n\n"
    assert value(S.relative_module(F.lit(""), F.lit(1), F.lit("x"))) == ".x" and value(S.relative_module(F.lit("a"), F.lit(2), F.lit("x"))) is None
    assert value(S.relative_module(F.lit(None).cast("string"), F.lit(1), F.lit("x"))) is None
    assert value(S.python_module(F.lit("a/b/__init__.py"))) == "a.b" and value(S.python_module(F.lit("A.PY"))) is None
    assert value(S.title(F.lit("## Folder: my proj.zip\nx"))) == "my proj" and value(S.title(F.lit("none"))) == "Codebase Documentation"
    assert value(S.format_bytes(F.lit(1536))) == "1.5 KB" and value(S.format_bytes(F.lit(0))) == "0 B"
    assert value(S.slot_text(F.lit("secret123456"), F.lit("m"), F.lit(3.2))) == "Slot(m, key=…123456, limited (3s))"
    assert value(S.prompt_code(F.lit(None).cast("string"), F.lit("python"))) == "  N/A"
    assert value(S.raw_content(F.lit("  　"))) == K.EMPTY_FILE


def test_json_previews():
    assert json_preview.preview('{"b": [1], "a": {"x": 1}, "s": "t", "n": null, "i": 1, "f": 1.5, "o": true}', 5).splitlines()[1:8] == [
        '  "b": array[1 items],', '  "a": object[1 keys],', '  "s": "t",', '  "n": NoneType,', '  "i": int,', '  "f": float,', '  "o": bool,',
    ]
    assert json_preview.preview("[1, 2, 3, 4, 5, 6]", 3).endswith("  5,\n  ... (1 more items)\n]  // 18 total chars — preview only")
    assert json_preview.preview("{bad", 2) == "{b\n\n... (truncated — 4 total chars, invalid JSON?)"


def test_schemas():
    assert schema.lookup("NODES")["id"] and schema.lookup("none") is None
    assert all(schema.lookup(n) for n in schema.TABLES)


def test_slots(spark):
    keys = spark.createDataFrame([("k1", 0), ("k2", 1)], "api_key string, place int")
    models = spark.createDataFrame([("a",), ("b",)], "model_name string")
    rows = tasks.slots(keys, models).withColumn("rate_limited_until", F.lit(None).cast("timestamp"))
    assert [(r.seq, r.api_key, r.model_name) for r in rows.orderBy("seq").collect()] == [(0, "k1", "a"), (1, "k1", "b"), (2, "k2", "a"), (3, "k2", "b")]
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    cooling = tasks.limited(rows, F.col("seq") < 3, now, F.lit(10.0))
    waiting = tasks.wait_seconds(cooling, now).first()
    assert (waiting.soonest, waiting.available) == (0.0, 1)
    assert tasks.wait_seconds(tasks.limited(rows, F.lit(True), now, F.lit(10.0)), now).first().soonest == 10.5
    assert tasks.first_available(cooling, ["model_name"], F.col("seq"), F.col("rate_limited_until").isNull()).count() == 1
    assert tasks.wait_seconds(tasks.reset(cooling), now).first().available == 4
