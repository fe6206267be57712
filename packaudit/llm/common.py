"""Arrow tasks, connected components and fixed numbers shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packaudit.functions.tables import cut, shared_folder

ROWS = 256  # rows of a text table handled at a time inside a task
CACHE_WORDS = 150_000  # words a task remembers; it then starts afresh, results stay the same


class WordTable(dict):
    """Word -> value, computed once per word and task; emptied between batches when full."""

    def __init__(self, compute: Callable):
        super().__init__()
        self._compute = compute

    def __missing__(self, word):
        value = self[word] = self._compute(word)
        return value

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()


def word_hashes(seed: int = 0) -> WordTable:
    return WordTable(lambda word: xxhash.xxh64_intdigest(word, seed))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def stretches(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Consecutive rows with the same keys, across batches, as one table each."""
    key, parts = None, []
    for batch in batches:
        start = 0
        for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in keys))):
            if k == key:
                continue
            if i > start:
                parts.append(batch.slice(start, i - start))
            if parts:
                yield pa.Table.from_batches(parts)
            key, parts, start = k, [], i
        if batch.num_rows > start:
            parts.append(batch.slice(start))
    if parts:
        yield pa.Table.from_batches(parts)


def texts(batch: pa.RecordBatch, name: str = "content") -> list[str]:
    """Texts of a batch; null reads as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def key_type(df: DataFrame, name: str = "path") -> str:
    return df.schema[name].dataType.simpleString()


def fold(column: str | Column, folds: int) -> Column:
    """crc32 of a key's text modulo ``folds``; a null key falls in fold 0."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, closely packed: for tables with texts or hashes."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, keys: list[str], order: list[str], place: str, size: str) -> DataFrame:
    """The rows with their place, from 0, among the rows of the same keys, and how many those are.

    One range shuffle sorts by keys and order, so a key that holds most rows lies in many
    partitions; equal rows are told apart by where they were read.  Rows are counted inside
    each partition, and what comes before a partition is one row per key and partition.
    """
    read = stored(df, "unplaced").withColumn("_seen", F.monotonically_increasing_id())
    ordered = read.repartitionByRange(*keys, *order, "_seen").sortWithinPartitions(*keys, *order, "_seen").drop("_seen")
    rows = stored(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "placed")
    runs = rows.groupBy("_part", *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_many"))
    every = Window.partitionBy(*keys)
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(runs.select(F.col("_part").alias("_of"), *(F.col(k).alias(f"_of{k}") for k in keys), "_first", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_before"), F.sum("_many").over(every).alias(size)), "runs")
    same = [rows[k].eqNullSafe(runs[f"_of{k}"]) for k in keys]
    both = rows.join(runs, [rows["_part"] == runs["_of"], *same])
    return both.withColumn(place, F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_of", *(f"_of{k}" for k in keys), "_first", "_before")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of the given links (a, b): root is the smallest node reached.

    Contraction: each node hooks to its smallest neighbour, chains of hooks are halved until
    flat, links are renamed to roots, and what still joins two roots goes to the next round.
    A round at least halves what is left, so rounds grow with the logarithm of the size.
    Every table is a checkpoint in the shared folder: both sides of each join are plain
    shuffles that adaptive execution can split when a root has very many members.
    Null ends, links to itself and repeated links change nothing.
    """
    links = cut(edges.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")))
        if hooks.isEmpty():
            break
        while True:
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            shorter = cut(hooks.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            hooks = shorter.select("node", "up")
            if shorter.where("moved").isEmpty():
                break
        # Written, so that Spark knows how small they are: links of a root with very many of them are
        # then met by broadcast; large tables are shuffled, and adaptive execution splits the root.
        hooks = stored(hooks, "hooks")
        labels = hooks.withColumnRenamed("up", "root") if labels is None else cut(
            labels.join(hooks.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        for end in ("a", "b"):
            links = links.join(hooks.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up")), end).drop(end).withColumnRenamed(f"{end}_up", end)
        links = cut(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
