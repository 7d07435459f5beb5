"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from repograph.llm.textmap import prepare

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (a local session, as in tests) a temporary one is set."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="repograph-")
        spark.conf.set(SETTING, folder)
    return folder


class Workspace:
    """Parquet tables of one run of an operator; a lost executor costs no more than the stage it was in."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.tables = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read again."""
        self.tables += 1
        path = f"{self.path}/{self.tables:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
