"""Passages that repeat across files, found level by level and taken out.

A window of ``window`` words that repeats contains shorter windows that repeat.  So short
windows come first; where they repeat in another file, and only there, windows of twice the
length are looked at, until no candidates survive or the asked length is reached.  Of the
first level not every position is needed: a repeated long window holds the same word hashes
in either file, hence the same smallest short window, so only windows that are smallest
within some long window are written down (about one position in thirteen).

The corpus is shuffled by file once.  Counting keys is partially aggregated, so a passage
that a third of all files share is one row per task; exact copies are settled by a digest of
the whole text and are never cut into windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.functions.tables import cut
from packaudit.llm.common import key_type, slices, stored, word_hashes

WINDOW = 50  # words
_ODD = 0x9E3779B97F4A7C15  # base of the window hashes, odd and so invertible
_MASK = (1 << 64) - 1


class Rolling:
    """Hashes of all windows of a length over a row of word hashes, modulo 2 to the 64."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def windows(self, words: np.ndarray, length: int) -> np.ndarray:
        n = len(words) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        if len(self.up) < len(words):
            size = 2 * len(words)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << 64))))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.down[:len(words)], dtype=np.uint64)])
        h = (sums[length:] - sums[:-length]) * self.up[:n]
        h ^= h >> np.uint64(31)
        return h * np.uint64(0xBF58476D1CE4E5B9)


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the (leftmost) smallest of some ``width`` neighbours, if so many there are."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    best, place, span = h.copy(), np.arange(len(h)), 1
    while span < width:  # smallest of spans that double
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        take = right < left
        best, place = np.where(take, right, left), np.where(take, place[step:], place[:-step])
        span += step
    return np.unique(place)


def _hashes(data: list[bytes], words) -> np.ndarray:
    return np.fromiter(map(words.__getitem__, data), np.uint64, len(data))


def _anchors(files: DataFrame, window: int) -> DataFrame:
    """(path, text_key, digest, n_words, anchors, places): per row, the first level's windows to compare."""
    half = (window + 1) // 2

    def run(batches):
        words, rolling = word_hashes(), Rolling()
        for batch in slices(batches):
            words.trim()
            digests, sizes, anchors, places = [], [], [], []
            for text in batch.column("content").to_pylist():
                data = (text or "").encode().split()
                h = rolling.windows(_hashes(data, words), half)
                at = smallest(h, window - half + 1)
                digests.append(hashlib.md5(b" ".join(data)).digest())
                sizes.append(len(data))
                anchors.append(h[at].view(np.int64))
                places.append(at.astype(np.int32))
            offsets = pa.array(np.cumsum([0, *map(len, places)]), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("path"), batch.column("text_key"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(anchors))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(places)))],
                ["path", "text_key", "digest", "n_words", "anchors", "places"])

    return files.mapInArrow(run, f"path {key_type(files)}, text_key bigint, digest binary, n_words bigint, anchors array<bigint>, places array<int>")


def _covered(n: int, starts, window: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    starts = np.asarray(starts, np.int64)
    starts = starts[starts < n]
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def dedupe(files: DataFrame, window: int = WINDOW) -> DataFrame:
    """(path, n_words, n_removed, content) per file: ``content`` is what is left, joined by one space.

    Words are runs without white space, unchanged.  A word goes if it is covered by a window
    of ``window`` consecutive words whose word sequence also starts in a file with a smaller
    path; windows are judged on the input, not on what is left.  Null and empty contents have
    no words.  Rows with the same path count as one place: none is smaller than the other,
    whether their texts are the same or not, and each row is judged by its own text.  A null
    path is smaller than none and has none smaller: its row stays whole.  Other columns are
    not read.
    """
    kind = key_type(files)
    half = (window + 1) // 2
    # A row is known by its path and a hash of its text, so rows that share a path keep apart.
    row = ["path", "text_key"]
    files = files.select("path", "content", F.xxhash64(F.coalesce("content", F.lit(""))).alias("text_key"))
    first = stored(_anchors(files, window), "anchors")

    # Exact copies: of files with the same words, all but the smallest path lose everything a window covers.
    least = cut(first.where("path is not null").groupBy("digest").agg(F.min("path").alias("least"), F.max("path").alias("most")).where("least < most"))
    copies = first.where(F.col("n_words") >= window).select(*row, "digest").join(least, "digest").where("path > least").select(*row, F.lit(True).alias("copy")).distinct()

    # Level one: anchors that also occur in another file.
    anchors = first.where("path is not null").select(*row, F.explode(F.arrays_zip("anchors", "places")).alias("a")).select(*row, F.col("a.anchors").alias("h"), F.col("a.places").alias("at"))
    repeated = cut(anchors.groupBy("h").agg(F.min("path").alias("least"), F.max("path").alias("most")).where("least < most").select("h"))
    survive = anchors.join(repeated, "h").groupBy(*row).agg(F.collect_set("at").alias("at"))  # at most a text's own positions
    plan = cut(survive.join(copies, row, "full").select(*row, "at", F.coalesce("copy", F.lit(False)).alias("copy")))

    # Level two: only around those anchors, windows of the full length.
    def extend(batches):
        words, rolling = word_hashes(), Rolling()
        check = word_hashes(1)
        for batch in slices(batches):
            words.trim(), check.trim()
            rows = {c: [] for c in ("n_words", "n_removed", "content", "h", "check", "at")}
            for text, at, copy in zip(*(batch.column(c).to_pylist() for c in ("content", "at", "copy"))):
                data = (text or "").encode().split()
                h = check_h = starts = None
                if not copy and at:
                    wide = np.zeros(max(0, len(data) - window + 1) + 1, np.int64)
                    at = np.array(at, np.int64)
                    at = at[at < len(data)]
                    np.add.at(wide, np.maximum(at + half - window, 0), 1)
                    np.add.at(wide, np.minimum(at + 1, len(wide) - 1), -1)
                    starts = np.flatnonzero(np.cumsum(wide[:-1]) > 0)
                    h = rolling.windows(_hashes(data, words), window)[starts].view(np.int64)
                    check_h = (rolling.windows(_hashes(data, check), window)[starts] >> np.uint64(33)).astype(np.int32)
                rows["n_words"].append(len(data))
                rows["n_removed"].append(len(data) if copy else 0)
                rows["content"].append("" if copy else b" ".join(data).decode())
                for c, v in (("h", h), ("check", check_h), ("at", None if starts is None else starts.astype(np.int32))):
                    rows[c].append(v)
            types = {"n_words": pa.int64(), "n_removed": pa.int64(), "content": pa.string(), "h": pa.list_(pa.int64()), "check": pa.list_(pa.int32()), "at": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("text_key"), *(pa.array(v, types[c]) for c, v in rows.items())], [*row, *rows])

    second = stored(files.join(plan, row, "left").mapInArrow(extend, f"path {kind}, text_key bigint, n_words bigint, n_removed bigint, content string, h array<bigint>, check array<int>, at array<int>"), "windows")
    open_ = second.where("h is not null and size(h) > 0")
    windows = open_.select(*row, F.explode(F.arrays_zip("h", "check", "at")).alias("w")).select(*row, F.col("w.h").alias("h"), F.col("w.check").alias("check"), F.col("w.at").alias("at"))
    owners = cut(windows.groupBy("h", "check").agg(F.min("path").alias("least"), F.max("path").alias("most")).where("least < most").select("h", "check", "least"))
    lost = windows.join(owners, ["h", "check"]).where("path > least").groupBy(*row).agg(F.collect_set("at").alias("lost"))

    def remove(batches):
        for batch in slices(batches):
            removed, kept = [], []
            for text, starts in zip(batch.column("content").to_pylist(), batch.column("lost").to_pylist()):
                data = text.split(" ") if text else []
                gone = _covered(len(data), starts or [], window)
                removed.append(int(gone.sum()))
                kept.append(" ".join(w for w, g in zip(data, gone) if not g) if removed[-1] else text)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["path", "n_words", "n_removed", "content"])

    schema = f"path {kind}, n_words bigint, n_removed bigint, content string"
    done = second.where("h is null or size(h) = 0").select("path", "n_words", "n_removed", "content")
    mended = open_.select(*row, "n_words", "content").join(lost, row, "left").mapInArrow(remove, schema)
    return done.unionByName(mended)
