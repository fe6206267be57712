"""Read package folders: one row per file, plus the selections the analyzers start from."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packaudit.functions import columns as c
from packaudit.functions import fixed
from packaudit.functions.tables import findings, first_rows, union_all, written

FILES = "skill_id string, path string, basename string, ext string, size bigint, is_binary boolean, content string"


SOURCE_LIMIT = 2**31 - 2  # bytes of a file that one value can hold
HEAD = 4096  # bytes that tell whether a file is binary
FOLDERS = 512  # folders that a task lists in a round, at most
DEALT = 32  # folders that a task starts a round with
READ_FILES, READ_BYTES = 2048, 256 << 20  # files and bytes that a reading task is meant to get
BATCH_BYTES = 16 << 20  # contents that a task holds at a time, unless one file is larger


def read_packages(spark: SparkSession, root: str, max_bytes: int | None = None,
                  extensions: list[str] = fixed.TEXT_EXTENSIONS) -> DataFrame:
    """Every file under ``root/<skill_id>/``, and a row with an empty path per package folder.

    Text files give their content.  Without content stay binary files, other kinds of files,
    files beyond what one value can hold (2 GiB) and, if ``max_bytes`` is given, longer ones;
    of these only the head is read, to test for being binary.  So no package and no file is
    missing, names that start with a dot or underscore included.

    Folders are listed and files are read in tasks (see ``list_tree``); the driver resolves
    the root and nothing else.  Files are dealt to the reading tasks by a hash of their path,
    so a package that holds most of them is read by many.
    """
    limit = SOURCE_LIMIT if max_bytes is None else min(max_bytes, SOURCE_LIMIT)
    uri = _resolved(spark, root)
    entries = list_tree(spark, uri, fixed.SKIP_DIRS)
    parts = F.split("path", "/", 2)
    inside = entries.filter(F.col("is_folder") != F.col("path").contains("/")).select(  # files below a package, and the packages
        parts[0].alias("skill_id"), F.when(F.col("is_folder"), "").otherwise(parts[1]).alias("path"), F.when(F.col("is_folder"), F.lit(0)).otherwise(F.col("length")).alias("length"))
    size = inside.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.least("length", F.lit(limit))), F.lit(0)).alias("bytes")).first()
    tasks = max(1, math.ceil(size["n"] / READ_FILES), math.ceil(size["bytes"] / READ_BYTES), min(size["n"], spark.sparkContext.defaultParallelism))

    def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _arrow_files(uri)
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["skill_id", "path", "length", "content"])

        for batch in batches:
            for skill, path, length in zip(*(batch.column(c).to_pylist() for c in ("skill_id", "path", "length"))):
                data = b""
                if path:
                    with files.open_input_stream(f"{base}/{skill}/{path}") as f:
                        data = f.read() if length <= limit else f.read(HEAD)
                rows.append((skill, path, length, data))
                held += len(data)
                if held >= BATCH_BYTES or len(rows) >= 1000:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    read = inside.repartition(tasks, "skill_id", "path").mapInArrow(reading, "skill_id string, path string, length bigint, content binary")
    return _shape(read, extensions, F.col("length") <= limit)


def _resolved(spark: SparkSession, root: str) -> str:
    """Full address of the root."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(top).toString().rstrip("/")


def list_tree(spark: SparkSession, uri: str, skip: list[str]) -> DataFrame:
    """(path, is_folder, length) for all below a root, by a frontier of folders.

    Folders are rows.  A task walks down from those it was dealt until it has listed FOLDERS
    of them and gives back what it has not come to, which the next round deals anew by a hash
    of the path.  So a round does a bounded amount of work per task, a package with very many
    folders is listed by many tasks, and small trees take one or two rounds.  Each round is
    written to the shared folder.  Folders with a name in ``skip`` are left out with all below.
    """
    left_out = set(skip)

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        files, base = _arrow_files(uri)
        open_ = [path for batch in batches for path in batch.column("path").to_pylist()]
        done, rows = 0, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), (pa.string(), pa.bool_(), pa.int64(), pa.bool_()))], ["path", "is_folder", "length", "open"])

        while open_ and done < FOLDERS:
            folder = open_.pop()
            done += 1
            for info in files.get_file_info(pafs.FileSelector(f"{base}/{folder}" if folder else base)):
                path = info.path[len(base) + 1:]
                is_folder = info.type == pafs.FileType.Directory
                if is_folder and info.base_name in left_out:
                    continue
                rows.append((path, is_folder, None if is_folder else info.size, False))
                if is_folder:
                    open_.append(path)
            if len(rows) >= 4096:
                yield flush()
                rows.clear()
        rows.extend((path, True, None, True) for path in open_)
        if rows:
            yield flush()

    found, frontier = [], spark.createDataFrame([("",)], "path string")
    while n := frontier.count():
        dealt = frontier.repartition(math.ceil(n / DEALT), "path")
        listed = written(dealt.mapInArrow(listing, "path string, is_folder boolean, length bigint, open boolean"), "listing")
        found.append(listed.filter("not open").drop("open"))
        frontier = listed.filter("open").select("path")
    return union_all(found)


def _shape(df: DataFrame, extensions: list[str], keep_text: Column) -> DataFrame:
    signs = [f"startswith(content, X'{h}')" for h in fixed.BINARY_MAGIC_HEX]
    is_binary = F.expr(" or ".join(signs + ["contains(substring(content, 1, 4096), X'00')"]))
    name, ext = c.basename(F.col("path")), c.extension(F.col("path"))
    text = F.when(keep_text & ~is_binary & (F.col("path") != "") & (ext.isin(extensions) | name.startswith(".")), F.make_valid_utf8(F.col("content").cast("string")))
    return df.select("skill_id", "path", name.alias("basename"), ext.alias("ext"), F.col("length").alias("size"), F.coalesce(is_binary, F.lit(False)).alias("is_binary"), text.alias("content"))


def _arrow_files(uri: str):
    from pyarrow import fs

    address = uri.replace("s3a://", "s3://", 1)
    if address.startswith("file:/") and not address.startswith("file://"):
        address = "file://" + address[len("file:"):]
    return fs.FileSystem.from_uri(address)


def list_packages(files: DataFrame, require_manifest: bool = False) -> DataFrame:
    """One row per package; hidden folders are none.  Optionally only those with a manifest."""
    shown = files.filter(~F.col("skill_id").startswith("."))
    if require_manifest:
        shown = shown.filter(F.col("path") == "SKILL.md")
    return shown.select("skill_id").distinct()


def staged(files: DataFrame) -> DataFrame:
    """Files written once to the shared folder, one partition per kind of file.

    Each extractor then reads only its own kind, and package listings read no contents.
    """
    ext = F.col("ext")
    kind = (F.when(F.col("is_binary"), "binary").when(ext == ".py", "py").when(ext.isin(fixed.SHELL_EXTENSIONS), "shell")
            .when(ext.isin(fixed.JS_EXTENSIONS), "js").when(ext.isin(".yaml", ".yml"), "yaml").when(ext.isin(".md", ".txt"), "doc").otherwise("other"))
    return written(files.withColumn("kind", kind), "files", partition="kind")


def of_kind(files: DataFrame, *kinds: str) -> DataFrame:
    """Only the given kinds, by partition, when the files are staged; else all files."""
    return files.filter(F.col("kind").isin(*kinds)) if "kind" in files.columns else files


def binary_findings(files: DataFrame) -> DataFrame:
    hit = files.filter("is_binary")
    return findings(hit, "code", "MEDIUM", "Obfuscation",
                    F.concat(F.lit("Binary file detected: "), F.col("path")), path=F.col("path"))


def text_files(files: DataFrame) -> DataFrame:
    return files.filter("not is_binary and content is not null")


def manifest_file(files: DataFrame) -> DataFrame:
    """The instruction file of each package, by order of preferred spelling."""
    tops = text_files(files).filter(F.col("path").isin(fixed.MANIFEST_NAMES))
    return first_rows(tops, ["skill_id"], [c.ranked(F.col("path"), fixed.MANIFEST_NAMES)])


def missing_manifest_findings(files: DataFrame) -> DataFrame:
    missing = list_packages(files).join(
        files.filter(F.col("path").isin(fixed.MANIFEST_NAMES[:3])).select("skill_id").distinct(),
        "skill_id", "left_anti")
    return findings(missing, "manifest", "MEDIUM", "Unknown",
                    "No SKILL.md found in skill directory", path="SKILL.md")


def injection_files(files: DataFrame) -> DataFrame:
    """Top-level instruction and config texts, in reading order.

    They stay one row per file: hits are counted per file and added up per package, so no
    package's texts are ever joined into a single value.
    """
    top = text_files(files).filter(~F.col("path").contains("/"))
    order = (
        F.when(F.col("path") == "SKILL.md", 0).when(F.col("path") == "skill.md", 1)
        .when(F.col("path") == "README.md", 2).when(F.col("ext") == ".yaml", 3)
        .when(F.col("ext") == ".yml", 4).when(F.col("ext") == ".txt", 5)
    )
    return top.withColumn("file_order", order).filter("file_order is not null")


def injection_sources(files: DataFrame) -> DataFrame:
    """Instruction file plus the Python files at the top and in ``scripts/``, kept per source."""
    return text_files(files).filter(
        (F.col("path") == "SKILL.md") | F.col("path").rlike(r"^(scripts/)?[^/]+\.py$"))


def non_python_sources(files: DataFrame) -> DataFrame:
    """Text files beside the code, which may hide code of their own."""
    return text_files(files).filter(
        F.col("path").rlike(r"^(scripts/)?[^/]+\.(txt|md|yaml|yml)$") & (F.col("basename") != "SKILL.md"))
