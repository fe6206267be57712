"""Registered package checks: built-in ones and those a user adds.

Every check is a job of its own that writes its findings to the shared folder.  What it wrote
counts only with the marker that the writer leaves last, so a check that fails half-way, in
planning or in one of its tasks, adds nothing but a LOW finding per package and leaves the
findings of the others as they are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.functions.tables import FINDINGS, committed, empty, findings, shared_folder, union_all
from packaudit.operators.manifest import audit_comments, audit_embedded, audit_manifest

Check = Callable[[dict[str, DataFrame]], DataFrame]

_checks: dict[str, Check] = {
    "embedded_resource": audit_embedded,
    "manifest_audit": audit_manifest,
    "comment_injection": audit_comments,
}


def register_check(name: str, fn: Check) -> None:
    """Add a check: a function from the audit's tables to a findings DataFrame."""
    _checks[name] = fn


def unregister_check(name: str) -> None:
    _checks.pop(name, None)


def registered() -> dict[str, Check]:
    return dict(_checks)


def reason(error: Exception) -> str:
    """What failed, in one line: of an error in a Python worker or a task, the innermost one."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    python = [line for line in lines if re.match(r"[A-Za-z_.]*(Error|Exception)\b", line)]
    raised = re.search(r"\[USER_RAISED_EXCEPTION\]\s*(.*?)(\s+SQLSTATE|$)", str(error))
    if raised:
        return raised[1]
    if "Traceback" in str(error) and python:
        return python[-1]
    return lines[0] if lines else type(error).__name__


def run_checks(tables: dict[str, DataFrame], checks: dict[str, Check] | None = None, folder: str | None = None) -> DataFrame:
    """Findings of all checks; one that fails gives a LOW finding per package instead.

    ``checks`` replaces the registered ones.  ``folder`` names where findings are written, by
    default a new place in the shared folder; checks that were committed there by an earlier,
    interrupted run are not run again.
    """
    spark = tables["files"].sparkSession
    want = empty(spark, FINDINGS).schema
    folder = folder or f"{shared_folder(spark)}/checks-{uuid.uuid4().hex}"
    out, failed = [empty(spark, FINDINGS)], {}
    for name, fn in (_checks if checks is None else checks).items():
        path = f"{folder}/{name.encode().hex()}"  # any name makes a folder
        try:
            if not committed(spark, path):
                found = fn(tables)
                found.select(*[F.col(f.name).cast(f.dataType) for f in want]).write.mode("overwrite").parquet(path)
        except Exception as error:  # a failing check must not stop the audit
            failed[name] = reason(error)
        else:
            out.append(spark.read.schema(want).parquet(path))
    if failed:
        packages = tables["files"].select("skill_id").distinct()
        out += [findings(packages, name, "LOW", "Unknown", f"Plugin '{name}' error: {why[:80]}") for name, why in failed.items()]
    return union_all(out)
