"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits; each is set if it is in over half of the hashes of the file's
four-word shingles.  Equal fingerprints are one class from then on.  To find all pairs that
differ in few bits, each fingerprint is cut into three segments: of two fingerprints at most
four bits apart, some segment differs in at most one bit.  So every fingerprint is stored
under its segments, looks up the small Hamming ball around each segment, and whole distances
are verified in the join.  Buckets too full for that are handled exactly another way (see
``crowded``), so no bucket is ever capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packaudit.functions.tables import cut
from packaudit.llm.common import components, key_type, slices

SHINGLE, SEED = 4, 42
DISTANCE = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit and width; radius DISTANCE // 3 in each
CROWDED = 4096  # fingerprints in one bucket beyond which it is not joined


def fingerprint(text: str) -> int:
    """Unsigned fingerprint: words are runs without white space, A-Z in lower case, repeats
    count.  Fewer than four words are one shingle; no words give zero."""
    words = text.encode().lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - SHINGLE + 1)
    line = memoryview(b" ".join(words))
    digest = xxhash.xxh64_intdigest
    last = (ends[SHINGLE - 1:] if len(words) >= SHINGLE else ends[-1:]) - 1
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip([0, *ends[:n - 1].tolist()], last.tolist())), "<u8", n)
    bits = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        bits += np.unpackbits(h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, fingerprint as a signed long) per file, from its whole content; null counts as empty."""

    def run(batches):
        for batch in slices(batches):
            out = np.array([fingerprint(t or "") for t in batch.column("content").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out.view(np.int64))], ["path", "fingerprint"])

    return files.select("path", "content").mapInArrow(run, f"path {key_type(files)}, fingerprint bigint")


def _segment(i: int) -> Column:
    """Segment value with the segment's number above it."""
    low, width = SEGMENTS[i]
    return F.shiftrightunsigned("f", low).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(i << 32))


def buckets(prints: DataFrame) -> DataFrame:
    """(f, bucket) of every fingerprint f: one row per segment."""
    return prints.select("f", F.explode(F.array(*(_segment(i) for i in range(len(SEGMENTS))))).alias("bucket"))


def probes(prints: DataFrame) -> DataFrame:
    """(f, bucket) that every fingerprint f looks up: each segment's value and those one bit off."""
    balls = [[_segment(i), *(_segment(i).bitwiseXOR(F.lit(1 << b)) for b in range(width))] for i, (_, width) in enumerate(SEGMENTS)]
    return prints.select("f", F.explode(F.array(*(c for ball in balls for c in ball))).alias("bucket"))


def crowded(prints: DataFrame, full: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints which reach a full bucket, exactly and without pairs.

    Two fingerprints at most four bits apart have a value at most two bits from both.  Each of
    these fingerprints is written under all values within two bits (2,081 rows); those that
    meet at a value form a chain in order of size.  At most 2,081 fingerprints can meet at a
    value, whatever the data.
    """
    near = probes(prints).join(full, "bucket", "left_semi").select("f").distinct()
    one = [1 << b if b < 63 else -(1 << 63) for b in range(64)]
    two = [a ^ b for i, a in enumerate(one) for b in one[:i]]
    at = near.select("f", F.explode(F.transform(F.array(*map(F.lit, [0, *one, *two])), lambda m: F.col("f").bitwiseXOR(m))).alias("value"))
    before = F.lag("f").over(Window.partitionBy("value").orderBy("f"))
    chained = at.select("f", before.alias("before")).where("before is not null")
    # Fingerprints that meet are each within two bits of the value, so at most four apart.
    return chained.select(F.col("before").alias("a"), F.col("f").alias("b")).distinct()


def links(prints: DataFrame) -> DataFrame:
    """(a, b) between distinct fingerprints (column f), a < b, so that linked ones are exactly
    those joined by steps of at most four differing bits."""
    prints = prints.where("f is not null")
    table = buckets(prints)
    full = cut(table.groupBy("bucket").count().where(F.col("count") > CROWDED).select("bucket"))
    asked = probes(prints)
    if not full.isEmpty():
        table, asked = table.join(full, "bucket", "left_anti"), asked.join(full, "bucket", "left_anti")
    a, b = asked.select(F.col("f").alias("a"), "bucket"), table.select(F.col("f").alias("b"), "bucket")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    found = a.join(b, (a["bucket"] == b["bucket"]) & close).select("a", "b")
    return found if full.isEmpty() else found.unionByName(crowded(prints, full))


def classes(files: DataFrame) -> DataFrame:
    """(path, fingerprint, component) per file: component is the smallest path reachable over
    links of at most four bits, the file's own included.

    Null contents count as empty; texts without words have fingerprint zero and are linked like
    any other.  Repeated paths keep their rows; null paths get a component but never name one,
    unless all of it is null.  Other columns are not read.
    """
    own = cut(fingerprints(files))
    prints = cut(own.groupBy(F.col("fingerprint").alias("f")).agg(F.min("path").alias("least")))
    joined = components(links(prints.select("f")))
    rooted = prints.join(joined.withColumnRenamed("node", "f"), "f", "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    rooted = cut(rooted)
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("component")))
    named = cut(rooted.join(least, "root").select(F.col("f").alias("fingerprint"), "component"))
    return own.join(named, "fingerprint", "left").select("path", "fingerprint", "component")


def keep_one(files: DataFrame) -> DataFrame:
    """The files, all columns, with one of each near-duplicate class: the one with the smallest
    path.  Rows that repeat that path stay, and so do all rows without a path."""
    kept = classes(files).where(F.col("path") == F.col("component")).select("path").distinct()
    return files.join(kept, "path", "left_semi").select(files.columns).unionByName(files.where("path is null"))
