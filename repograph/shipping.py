"""Sends this package to the Python workers, which need not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: the package's sources as an archive that Spark hands to every executor."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():  # not if it was itself read from an archive
        path = os.path.join(tempfile.mkdtemp(prefix="repograph-package-"), "repograph_package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for source in sorted(package.rglob("*.py")):
                archive.write(source, source.relative_to(package.parent).as_posix())
        context.addPyFile(path)
    _sent.add(context.applicationId)
