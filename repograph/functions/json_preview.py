"""A preview of JSON that keeps the order of its keys, which the engine's own JSON types do not."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repograph import constants as K

_NAMES = {int: "int", float: "float", bool: "bool", type(None): "NoneType", str: "str"}


def hint(value) -> str:
    if isinstance(value, list):
        return f"array[{len(value)} items]"
    if isinstance(value, dict):
        return f"object[{len(value)} keys]"
    return f'"{value}"' if isinstance(value, str) and len(value) < K.JSON_STRING else _NAMES[type(value)]


def preview(text: str, limit: int = K.CONTENT_LIMIT) -> str:
    size = len(text)
    try:
        value = json.loads(text)
    except ValueError:
        return f"{text[:limit]}\n\n... (truncated — {size} total chars, invalid JSON?)"
    end = f"  // {size} total chars — preview only"
    if isinstance(value, dict):
        lines = [f'  "{k}": {hint(v)},' for k, v in list(value.items())[: K.JSON_KEYS]]
        more = len(value) - K.JSON_KEYS
        return "\n".join(["{", *lines, *[f"  ... ({more} more top-level keys)"] * (more > 0), "}" + end])
    if isinstance(value, list):
        lines = [f"  {json.dumps(v)[: K.JSON_ITEM_CHARS]}," for v in value[: K.JSON_ITEMS]]
        more = len(value) - K.JSON_ITEMS
        return "\n".join([f"[  // array of {len(value)} items", *lines, *[f"  ... ({more} more items)"] * (more > 0), "]" + end])
    return f"{text[:limit]}\n\n... (truncated — {size} total chars)"


@F.pandas_udf(T.StringType())
def json_preview(text: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else preview(t, int(n)) for t, n in zip(text, limit)], dtype=object)
