"""Tables other systems supply, the reports written out, and the two-site hand-over."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packaudit.functions.tables import committed, empty

EXTERNAL = {
    "instruction_units": (
        "skill_id string, step_index int, text string, action_type string, resource_scope string, "
        "is_conditional boolean, is_explicit boolean, scope_vs_manifest double, command string, "
        "target string, skip_to_step int, parent_step int"
    ),
    "contracts": (
        "skill_id string, step_id string, allowed_file_reads array<string>, "
        "allowed_file_writes array<string>, allowed_network array<string>, "
        "allowed_subprocesses array<string>, allowed_env_vars array<string>, "
        "sensitive_ok boolean, network_ok boolean"
    ),
    "steps": (
        "skill_id string, step_index int, step_id string, action string, description string, "
        "target_script string, input_refs array<string>, output_name string, declared_scope string, "
        "condition string, branch_true string, branch_false string"
    ),
    "unit_scores": (
        "skill_id string, step_index int, i_mis double, i_exp double, i_exf double, i_cam double, "
        "i_priv double, reasoning string"
    ),
    "unit_chains": "skill_id string, kill_chain boolean, kill_chain_text string",
    "finding_verdicts": (
        "skill_id string, finding_index int, is_genuine boolean, confidence double, reasoning string"
    ),
    "judge_verdicts": (
        "skill_id string, judge_role string, risk_score double, confidence double, "
        "is_malicious boolean, threat_categories array<string>, evidence array<string>, reasoning string"
    ),
    "url_reputation": (
        "url string, malicious int, suspicious int, harmless int, undetected int, permalink string"
    ),
    "labels": "skill_id string, is_malicious boolean",
}


def load_external(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """A supplied table with its declared schema; no path means the table is absent."""
    if path is None:
        return empty(spark, EXTERNAL[name])
    return conform(spark.read.parquet(path), name)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Check and order a supplied table's columns; extra columns are dropped."""
    schema = T.StructType.fromDDL(EXTERNAL[name])
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks columns {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def write_reports(reports: DataFrame, evidence: DataFrame, path: str) -> None:
    """One JSON object per package, by verdict, and its evidence as a child data set.

    Evidence stays one row per item: a package with very many items never becomes one value.
    """
    # The folder is named by a copy, so that the verdict stays in each object.
    reports.withColumn("by_verdict", F.col("verdict")).write.mode("overwrite").partitionBy("by_verdict").json(f"{path}/reports")
    (evidence.repartition("skill_id", "evidence_type", "script")
     .sortWithinPartitions("skill_id", F.desc("rank"), "evidence_type", "seq")
     .write.mode("overwrite").json(f"{path}/evidence"))


MANIFEST = "name string, schema string, n_rows bigint"


def save_phase1(tables: dict[str, DataFrame], path: str) -> str:
    """Hand the tables of phase 1 over; returns the name of the hand-over.

    Each hand-over is a new folder under ``path``.  Its manifest, with the schema and the
    number of rows of every table, is written after all of them, and only a manifest that was
    written to its end makes it count; a crash before that leaves the last one as it was.
    """
    spark = next(iter(tables.values())).sparkSession
    handover = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    rows = []
    for name, df in tables.items():
        df.write.parquet(f"{path}/{handover}/{name}")
        rows.append((name, df.schema.json(), spark.read.schema(df.schema).parquet(f"{path}/{handover}/{name}").count()))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{path}/manifests/{handover}")
    return handover


def handovers(spark: SparkSession, path: str) -> list[str]:
    """Committed hand-overs under ``path``, oldest first."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(top)]
    return sorted(n for n in names if committed(spark, f"{path}/manifests/{n}"))


def load_phase1(spark: SparkSession, path: str, names: list[str] | None = None, handover: str | None = None) -> dict[str, DataFrame]:
    """Tables of the last committed hand-over, or of the one named; all of them by default.

    Refused are a hand-over that was not committed, a table it does not have, and a table whose
    columns or number of rows are not those of the manifest.
    """
    known = handovers(spark, path)
    chosen = handover or (known[-1] if known else None)
    if chosen not in known:
        raise ValueError(f"no committed hand-over {chosen or ''} under {path}")
    told = {r["name"]: r for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{chosen}").collect()}
    out = {}
    for name in told if names is None else names:
        if name not in told:
            raise ValueError(f"hand-over {chosen} has no table {name}")
        want = T.StructType.fromJson(json.loads(told[name]["schema"]))
        place = f"{path}/{chosen}/{name}"
        have = spark.read.parquet(place) if want.fields else spark.read.schema(want).parquet(place)
        if [(f.name, f.dataType) for f in have.schema] != [(f.name, f.dataType) for f in _nullable(want)]:
            raise ValueError(f"columns of {name} are not those handed over: {have.schema.simpleString()}")
        if have.count() != told[name]["n_rows"]:
            raise ValueError(f"{name} has not the {told[name]['n_rows']} rows handed over")
        out[name] = spark.read.schema(want).parquet(place)
    return out


def _nullable(schema: T.StructType) -> T.StructType:
    """The schema as a file gives it back: every value may be null."""

    def open_(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name, open_(f.dataType), True) for f in kind])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(open_(kind.elementType), True)
        if isinstance(kind, T.MapType):
            return T.MapType(open_(kind.keyType), open_(kind.valueType), True)
        return kind

    return open_(schema)


def graph_export(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges with what a viewer needs to draw them."""
    shown = nodes.select(
        "skill_id", "id", "node_type", "label", "path", "line", F.round("risk", 3).alias("risk"),
        F.when(F.col("node_type").startswith("nl"), "instruction")
        .when(F.col("node_type") == "permission", "permission").otherwise("code").alias("layer"),
    )
    shown.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
