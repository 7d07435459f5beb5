"""Bitmaps that mark what a scan is to hand on: sized by the number of marks, sent to all tasks."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm.hashing import U64

#: Bits of a bitmap: 16 for each mark, between these powers of two (128 KB to 16 MB). Beyond, more is handed on in vain, and
#: the join that follows takes it out.
LEAST, MOST = 20, 27


def bitmap(marks: DataFrame) -> Broadcast:
    """Of the one column of ``marks``, longs that are spread over all bits."""
    (column,) = marks.columns
    bits = min(MOST, max(LEAST, (16 * marks.count()).bit_length()))
    own = marks.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("mark"))
    maps = own.groupBy((F.col("mark") / 32768).cast("long").alias("part")).agg(F.expr("bitmap_construct_agg(mark % 32768)").alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in maps.toLocalIterator():  # at most 2^MOST / 32768 rows of 4 KB
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return marks.sparkSession.sparkContext.broadcast(out.tobytes())


def marked(bitmap: bytes, values: np.ndarray) -> np.ndarray:
    """Which of the values may be among the marks."""
    bits = np.frombuffer(bitmap, np.uint8)
    mark = values.view(U64) & U64(8 * len(bits) - 1)
    return (bits[(mark >> U64(3)).astype(np.int64)] >> (mark & U64(7)).astype(np.uint8) & 1).astype(bool)
