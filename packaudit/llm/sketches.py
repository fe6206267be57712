"""Document fingerprints: threshold-scaled sketches of word shingles.

A fingerprint keeps every hash of a five-word shingle that falls below a fixed fraction of
the hash range.  Fingerprints of parts merge by union, and since all texts keep the same
part of the range, containment can be estimated between texts of very unequal length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packaudit.llm.common import key_type, slices, stored, texts, word_hashes

SHINGLE = 5  # words
KEPT = 2  # one hash in so many is kept: few enough for long texts, enough for texts of some ten words
_MIX = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) ** 3 & (1 << 64) - 1 | 1) for i in range(SHINGLE)]
BITS = 40  # of a hash
_LIMIT = np.uint64((1 << BITS) // KEPT)


def sketch(text: str, words) -> np.ndarray:
    """Sorted distinct hashes of a text's fingerprint.  ``words`` remembers hashes of words.

    Words are runs without white space, ASCII letters in lower case; a text of fewer than
    five words is one shingle.  Where no hash falls below the limit the smallest one stands in,
    so only a text without words has an empty fingerprint; as a stand-in lies over the limit,
    ``merge`` drops it as soon as a part has a hash below, just as a sketch of the whole would.
    """
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - SHINGLE + 1)
    x = np.full(n, min(len(h), SHINGLE), np.uint64)
    for i in range(min(len(h), SHINGLE)):
        x += h[i:i + n] * _MIX[i]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x >>= np.uint64(64 - BITS)
    kept = x[x < _LIMIT]
    return np.unique(kept) if len(kept) else x[[x.argmin()]]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of two parts together (but for shingles across their border)."""
    both = np.union1d(a, b)
    kept = both[both < _LIMIT]
    return kept if len(kept) else both[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated containment of the smaller text in the larger; two texts without words are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def written(a: np.ndarray) -> str:
    octets = a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8:]
    return octets.tobytes().hex()


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, fingerprint) per file, from its whole content: 10 hex digits per kept hash, ascending.

    Null and empty contents have the empty fingerprint.  One row per input row; other columns
    are not read.
    """

    def run(batches):
        words = word_hashes()
        for batch in slices(batches):
            words.trim()
            out = [written(sketch(t, words)) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], ["path", "fingerprint"])

    return files.select("path", "content").mapInArrow(run, f"path {key_type(files)}, fingerprint string")


def with_neighbours(files: DataFrame) -> DataFrame:
    """Each file against an edited version of itself and against the next file by path.

    The edit replaces the last quarter of a content's characters by as many of the start of
    the next file's (or all of it); the last file is followed by the first.  Returns path,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  Null
    contents count as empty; a null path comes first; rows with the same path follow each
    other by content.  A table of one file compares it with itself.

    One range shuffle brings neighbours together and a partition pairs its own rows.  Of each
    partition the last row meets the first one of the next partition that has rows, in a join
    on the number of the partition.
    """
    spark = files.sparkSession
    kind = key_type(files)
    schema = f"path {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    # A given number of partitions is never merged, so both readers of the shuffle see the same ones.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = files.select("path", "content").repartitionByRange(parts, "path").sortWithinPartitions("path", "content")

    def compare(rows, words):
        """Rows of the result for consecutive (path, content) rows, but for the last one."""
        path = text = own = None
        first = True
        for next_path, next_text in rows:
            nxt = sketch(next_text, words)
            if not first:
                n = len(text)
                cut = n // 4
                edited = text[:n - cut] + next_text[:cut]
                e = sketch(edited, words)
                yield path, n, hashlib.sha256(edited.encode()).hexdigest(), written(own), written(e), likeness(own, e), likeness(own, nxt)
            path, text, own, first = next_path, next_text, nxt, False

    def batches_of(found, path_type):
        names = ["path", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [path_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        block = []
        for row in found:
            block.append(row)
            if len(block) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), types)], names)
                block = []
        if block:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), types)], names)

    def rows_of(batches, words, seen):
        for batch in slices(batches):
            words.trim()
            seen["type"] = batch.schema.field("path").type
            yield from zip(batch.column("path").to_pylist(), texts(batch))

    def inside(batches):
        words, seen = word_hashes(), {}
        found = compare(rows_of(batches, words, seen), words)
        first = next(found, None)
        if first is not None:
            yield from batches_of((r for part in ((first,), found) for r in part), seen["type"])

    def borders(batches):
        first = last = None
        for batch in slices(batches):
            if batch.num_rows:
                first = first or batch.slice(0, 1)
                last = batch.slice(batch.num_rows - 1, 1)
        if first is not None:
            part = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_arrays([part, *first.columns, *last.columns], ["part", "path", "content", "last_path", "last_content"])

    def across(batches):
        words = word_hashes()
        found = (r for batch in slices(batches) for path, text, following in zip(*(batch.column(i).to_pylist() for i in range(3)))
                 for r in compare([(path, text or ""), (None, following or "")], words))
        yield from batches_of(found, key_arrow)

    from pyspark.sql.pandas.types import to_arrow_type

    key_arrow = to_arrow_type(files.schema["path"].dataType)
    edges = stored(ordered.mapInArrow(borders, f"part int, path {kind}, content string, last_path {kind}, last_content string"), "borders")
    # Partition numbers alone are put in order: one integer per partition.
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    pairs = edges.join(edges.select("part").withColumn("following", following), "part").select("following", "last_path", "last_content")
    heads = edges.select(F.col("part").alias("following"), F.col("content").alias("head"))
    joined = pairs.join(heads, "following").select("last_path", "last_content", "head").mapInArrow(across, schema)
    return ordered.mapInArrow(inside, schema).unionByName(joined)
