"""Files of archives and folders as rows, and the code nodes in them."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from repograph import constants as K
from repograph.functions import scalars as S
from repograph.functions.json_preview import json_preview
from repograph.parsers import facts, python_source, script_source
from repograph.shipping import ship

MEMBER = "archive string, path string, is_dir boolean, length bigint, crc_ok boolean, content binary"
MEMBER_ARROW = pa.schema(
    [("archive", pa.string()), ("path", pa.string()), ("is_dir", pa.bool_()), ("length", pa.int64()), ("crc_ok", pa.bool_()), ("content", pa.binary())]
)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """A row for each member of each archive under ``path``; one that is damaged has no content and ``crc_ok`` false.

    An archive is read by one task, a member at a time. A file that is no archive is one member without a path.
    """
    schema = MEMBER_ARROW

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    yield pa.RecordBatch.from_pylist([{"archive": name, "path": None, "is_dir": False, "length": len(content), "crc_ok": False, "content": None}], schema)
                    continue
                for info in archive.infolist():
                    try:
                        data, ok = (None, True) if info.is_dir() else (archive.read(info), True)
                    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError):
                        data, ok = None, False
                    row = {"archive": name, "path": info.filename, "is_dir": info.is_dir(), "length": info.file_size, "crc_ok": ok, "content": data}
                    yield pa.RecordBatch.from_pylist([row], schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, MEMBER)


def folder_files(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """Members (as of an archive) for all files below a folder that the driver and the executors reach.

    The engine's own file sources leave out names that begin with ``_`` or ``.``, such as a package's first file, so the
    driver lists the names and tasks read the contents.
    """
    system, base = FileSystem.from_uri(root) if "://" in root else (None, root)
    listed = (system or LocalFileSystem()).get_file_info(FileSelector(base, recursive=True))
    names = sorted(i.path for i in listed if i.type == FileType.File)
    schema = MEMBER_ARROW

    def run(batches):
        system = FileSystem.from_uri(root)[0] if "://" in root else LocalFileSystem()
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with system.open_input_stream(path) as f:
                    data = f.read()
                inside = path[len(base.rstrip("/")) + 1 :]
                yield pa.RecordBatch.from_pylist([{"archive": root, "path": inside, "is_dir": False, "length": len(data), "crc_ok": True, "content": data}], schema)

    paths = spark.createDataFrame([(n,) for n in names], "path string")
    n = partitions or min(len(names) // 100 + 1, 10_000)
    return paths.repartition(n).mapInArrow(run, MEMBER)


def classified(members: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """With safe, excluded, supported and ``accepted``: what is unpacked."""
    path = F.col("path")
    rows = members.withColumns(
        {"safe": S.safe_path(path), "excluded": S.excluded(path, F.col("is_dir"), patterns), "supported": S.supported(path)}
    )
    return rows.withColumn("accepted", ~F.col("is_dir") & F.col("crc_ok") & F.col("safe") & ~F.col("excluded") & F.col("supported"))


def extraction_counts(rows: DataFrame) -> DataFrame:
    """How many members were unpacked, by kind, and how many were left out."""
    kind = S.file_kind(F.col("path"))
    return rows.agg(
        F.count_if(F.col("accepted") & (kind == "PYTHON")).alias("python_files"),
        F.count_if(F.col("accepted") & (kind == "SCRIPT")).alias("script_files"),
        F.count_if(F.col("accepted") & kind.isin(*K.CONFIG_KINDS)).alias("config_files"),
        F.count_if(~F.col("is_dir") & F.col("excluded")).alias("excluded_files"),
        F.count_if(~F.col("is_dir") & ~F.col("excluded") & ~F.col("supported")).alias("unsupported_files"),
    )


def upload_faults(archives: DataFrame, most: int) -> DataFrame:
    """(path, fault) of archives that are too large or no archives; ``archives`` as of the binaryFile source."""
    large = F.when(F.col("length") > most, F.format_string("larger than %d bytes", F.lit(most)))
    kind = F.when(F.substring("content", 1, 2) != F.lit(b"PK"), "not an archive")
    return archives.select("path", F.coalesce(large, kind).alias("fault")).where("fault IS NOT NULL")


def parsed(files: DataFrame) -> DataFrame:
    """(project, path, kind, module_path, language, raw_content, nodes, calls, parse_error) of accepted files.

    ``project`` is the archive or folder that a file came from, empty where ``files`` doesn't tell; equal paths of different
    projects are different files. Source is parsed in one narrow Python stage; text and configuration files keep their
    content, cut in the engine.
    """
    ship(files.sparkSession)
    kind = S.file_kind(F.col("path"))
    project = F.coalesce(F.col("archive") if "archive" in files.columns else F.lit(None).cast("string"), F.lit(""))
    rows = files.select(project.alias("project"), "path", "content", kind.alias("kind")).where("kind IS NOT NULL")

    def run(batches):
        for batch in batches:
            out = []
            for project, path, content, kind in zip(*(batch.column(c).to_pylist() for c in ("project", "path", "content", "kind"))):
                made = python_source.parse(content) if kind == "PYTHON" else script_source.parse(content, path)
                out.append({"project": project, "path": path, "kind": kind} | made)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    ddl = f"project string, path string, kind string, {facts.FACTS}"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    source = rows.where(F.col("kind").isin("PYTHON", "SCRIPT")).mapInArrow(run, ddl)
    path = F.col("path")
    source = source.select(
        "project",
        "path",
        "kind",
        F.when(F.col("kind") == "PYTHON", S.python_module(path)).otherwise(S.script_module(path)).alias("module_path"),
        F.when(F.col("kind") == "PYTHON", "python").when(S.extension(path).isin(".ts", ".tsx"), "typescript").otherwise("javascript").alias("language"),
        F.lit(None).cast("string").alias("raw_content"),
        "nodes",
        "calls",
        "parse_error",
    )
    text = F.make_valid_utf8(F.col("content").cast("string"))
    content = F.when(F.col("kind") == "JSON_FILE", json_content(text))
    for name, limit in K.CONTENT_LIMITS.items():
        content = content.when(F.col("kind") == name, S.raw_content(text, limit))
    config = rows.where(F.col("kind").isin(*K.CONFIG_KINDS)).select(
        "project",
        "path",
        "kind",
        F.lit(None).cast("string").alias("module_path"),
        F.lit(None).cast("string").alias("language"),
        content.otherwise(S.raw_content(text)).alias("raw_content"),
        F.array().cast(f"array<{facts.NODE}>").alias("nodes"),
        F.array().cast(f"array<{facts.CALL}>").alias("calls"),
        F.lit(None).cast("string").alias("parse_error"),
    )
    return source.unionByName(config)


def json_content(text, limit: int = K.CONTENT_LIMIT):
    """Long JSON as a preview of its keys or first items, in their order; the rest as other files."""
    return F.when((F.length(text) > limit) & ~S.is_blank(text), json_preview(text, F.lit(limit))).otherwise(S.raw_content(text, limit))
