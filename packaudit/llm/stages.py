"""Stages of the corpus pipeline: each takes all that the one before kept and returns documents,
the last one their tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packaudit.llm import mixture, pieces, private, quality, simhash
from packaudit.llm.queries import table, tokenizer

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 1024  # of whole documents that Arrow hands to a task's Python at a time


def _files(docs: DataFrame) -> DataFrame:
    """Documents as files.  Sets the session's Arrow batches to ROWS, as one session runs all
    stages in the same executors and larger batches would add up there."""
    docs.sparkSession.conf.set(BATCH, ROWS)
    return docs.withColumnsRenamed({"doc_id": "path", "text": "content"})


def _documents(files: DataFrame) -> DataFrame:
    return files.withColumnsRenamed({"path": "doc_id", "content": "text"}).select(*DOCUMENT)


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.col("quality").alias("label"))
    return _documents(quality.accept(_files(docs), labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return _documents(simhash.keep_one(_files(docs)))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind."""
    return _documents(private.redact(_files(docs)).withColumn("n_chars", F.char_length("content").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources share the corpus by the square root of their size; documents repeat or go."""
    files = _files(docs)
    return _documents(mixture.mix(files, mixture.tempered(files, "source"), "source"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): the ids of each document and what they decode to."""
    tokens = pieces.round_trip(_files(docs), tokenizer(spark))
    return tokens.select(F.col("path").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("content").alias("text"))


STAGES = [
    ("quality", accept_quality),
    ("simhash", drop_near_copies),
    ("private", hide_private),
    ("mixture", mix_sources),
    ("pieces", encode_pieces),
]
