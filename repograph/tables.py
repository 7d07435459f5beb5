"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def keeper(spark: SparkSession, name: str) -> Callable[[DataFrame, str], DataFrame]:
    """Writes a table below the folder in ``spark.checkpoint.dir`` and reads it again. Where that is unset, which only a
    local session may have, it is set to a temporary folder."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="repograph-")
        spark.conf.set(SETTING, folder)
    base = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(df: DataFrame, table: str) -> DataFrame:
        df.write.parquet(f"{base}/{table}")
        return spark.read.schema(df.schema).parquet(f"{base}/{table}")

    return keep
