"""From raw documents to token ids: language, lines, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it again as the next one's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.llm import bpe, decontaminate, language_crf, line_dedup, simhash_dedup
from repograph.llm.storage import Workspace

#: Prefix of columns that only live within a stage.
OWN = "__pipeline_"
#: A document goes if no language reaches this mean probability over its words, or if it has no letter.
LEAST_SCORE = 0.3
#: Near-duplicates: five-word shingles; at most three of 64 bits apart, or with so similar sets of shingles.
SHINGLE, BITS, SIMILARITY = 5, 3, 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no letter or whose language stays open; a null text has no letter. Where no document
    has a language to learn from, letters alone decide."""
    model = language_crf.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_crf.identify(docs, model, keep=docs.columns, prefix=OWN)
    sure = (F.col(f"{OWN}lang_pred") != language_crf.UNKNOWN) & (F.col(f"{OWN}score") >= LEAST_SCORE)
    return _plain(found.where(sure), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the first occurrences of its lines only; ``n_chars`` follows the text."""
    out = _plain(line_dedup.dedup_lines(docs, prefix=OWN), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, with the smallest id."""
    return simhash_dedup.one_of_each(docs, words=SHINGLE, limit=BITS, similarity=SIMILARITY)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, benchmark, keep=docs.columns, prefix=OWN)
    return _plain(found.where(F.col(f"{OWN}n_hit") == 0), docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of the whole text, and their number."""
    encoded = bpe.encode(docs, bpe.default_path(), keep=["doc_id"])
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


def _plain(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in docs.columns))


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("documents", dedup_documents),
    ("benchmark", drop_benchmark_leaks),
    ("tokens", encode_tokens),
]

#: Hashing, learning and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
