from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

FILE_SCHEMA = "skill_id string, path string, basename string, ext string, size bigint, is_binary boolean, content string"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").appName("packaudit-tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("packaudit.spread", "8")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate())
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """Build a files table from {package: {path: text}}."""

    def make(packages: dict[str, dict[str, str]]):
        rows = []
        for skill, files in packages.items():
            for path, text in files.items():
                base = path.rsplit("/", 1)[-1]
                ext = "." + base.rsplit(".", 1)[1].lower() if "." in base[1:] else ""
                rows.append((skill, path, base, ext, len(text.encode()), False, text))
        return spark.createDataFrame(rows, FILE_SCHEMA)

    return make
