"""Small relational helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SESSION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # lets a skewed package be split even when the next step aggregates on the same key
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set SESSION_SETTINGS on the caller's session.  They stay set: the plans that follow run lazily."""
    for key, value in SESSION_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder of this application for checkpoints and written hand-over tables.

    The cluster names the place in ``spark.checkpoint.dir``; where that is unset it is the
    warehouse, which executors share as well.  ``clear_shared_folder`` removes it.
    """
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    folder = f"{place.rstrip('/')}/packaudit-{sc.applicationId}"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def clear_shared_folder(spark: SparkSession) -> None:
    """Remove what this application wrote to its shared folder.  Call it once results are saved."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so a lost executor costs no recomputed lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: later reads prune columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write if partition is None else df.write.partitionBy(partition)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: the writer leaves its marker last."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int | None = 1) -> DataFrame:
    """First ``n`` rows per key in a total order; all of them if ``n`` is None.

    Spark plans this as a group limit: each task keeps at most ``n`` rows per key before
    the shuffle, so a key that holds much of the data stays cheap.
    """
    if n is None:
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def fill(df: DataFrame, values: dict) -> DataFrame:
    """Replace nulls that a left join leaves, for the listed columns."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in values.items()})


FINDING_COLUMNS = ["skill_id", "analyzer", "severity", "category", "description", "path", "line", "evidence", "confidence", "pos"]
FINDINGS = (
    "skill_id string, analyzer string, severity string, category string, description string, "
    "path string, line int, evidence string, confidence double, pos int"
)


def findings(df: DataFrame, analyzer: str, severity, category, description, path=None, line=None,
             evidence=None, confidence=1.0, pos=None) -> DataFrame:
    """Project any table to the shared finding shape; plain values become literals."""

    def col(v, kind):
        return (v if isinstance(v, Column) else F.lit(v)).cast(kind)

    return df.select(
        "skill_id",
        F.lit(analyzer).alias("analyzer"),
        col(severity, "string").alias("severity"),
        col(category, "string").alias("category"),
        col(description, "string").alias("description"),
        col("" if path is None else path, "string").alias("path"),
        col(0 if line is None else line, "int").alias("line"),
        col("" if evidence is None else evidence, "string").alias("evidence"),
        col(confidence, "double").alias("confidence"),
        col(0 if pos is None else pos, "int").alias("pos"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def numbered(df: DataFrame, key: str, bucket: list[str], order: list[Column], name: str) -> DataFrame:
    """Number a key's rows from 0 in (bucket, order) without sorting the whole key in one task.

    Rows are numbered inside each bucket; an offset per bucket comes from the bucket sizes.
    """
    sizes = df.groupBy(key, *bucket).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(key).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, *bucket, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(key, *bucket).orderBy(*order)) - 1
    return df.withColumn("_inside", inside).join(offsets, [key, *bucket]).withColumn(
        name, (F.col("_inside") + F.col("_offset")).cast("int")).drop("_inside", "_offset")
