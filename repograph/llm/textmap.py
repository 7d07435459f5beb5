"""Running a Python function over a text column in Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from repograph.shipping import ship

#: Texts are handed over in pieces of about so many bytes (a longer text is a piece of its own).
PIECE_BYTES = 1 << 20
#: Arrow batches between the engine and Python hold at most so much, in each running task.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

_TEXT = "__repograph_text"


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts add up to about ``limit`` bytes."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    owner = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        yield batch.slice(start, end - start)


def give_back() -> None:
    """Returns freed memory to the system: idle workers stay, and an executor's memory is shared by all of them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """The function over batches, giving memory back when a task ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def prepare(spark: SparkSession) -> None:
    """Sends the package to the workers, and lowers the session's limit of an Arrow batch, which an executor holds several
    times over for each task."""
    ship(spark)
    size = spark.conf.get(BATCH_SETTING).lower()
    unit = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(size[-1:])
    if not 0 < int(size[:-1] if unit else size) * (unit or 1) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The texts in UTF-8, null as None."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def free_names(columns: list[str], results: list[str]) -> list[str]:
    """The columns' names next to results: one that a result has too, in any case of letters, gets ``input_`` in front."""
    taken, given, out = {r.lower() for r in results}, {c.lower() for c in columns}, []
    for name in columns:
        new = name
        while new.lower() in taken or (new != name and new.lower() in given):
            new = f"input_{new}"
        out.append(new)
    return out


def map_texts(
    df: DataFrame,
    text: str,
    keep: list[str],
    added: T.StructType,
    function: Callable[[list[bytes | None]], dict[str, object]],
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """The ``keep`` columns of ``df`` and the ``added`` ones, which ``function`` makes from a list of texts.

    The plan is one narrow ArrowPython stage: no shuffle, and no more than one piece of texts in Python at a time. A kept
    column that has an added one's name is returned as ``input_`` and the name.
    """
    prepare(df.sparkSession)
    types = {f.name: to_arrow_type(f.dataType) for f in added.fields}
    own = [f"__keep{i}" for i in range(len(keep))]
    schema = T.StructType([*(T.StructField(n, df.schema[c].dataType, df.schema[c].nullable) for n, c in zip(own, keep)), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, _TEXT, piece_bytes):
                made = function(as_bytes(piece.column(_TEXT)))
                columns = [piece.column(c) for c in own]
                names = list(own)
                for name, kind in types.items():
                    value = made[name]
                    columns.append(value if isinstance(value, pa.Array) else pa.array(value, type=kind))
                    names.append(name)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = df.select(*(F.col(f"`{c}`").alias(n) for n, c in zip(own, keep)), F.col(f"`{text}`").cast("string").alias(_TEXT))
    return source.mapInArrow(tidy(run), schema).toDF(*free_names(keep, list(types)), *types)
