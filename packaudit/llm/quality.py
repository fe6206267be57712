"""Quality of a text: kernel ridge on document statistics by random Fourier features.

Statistics of every whole text are taken once, in one pass without a shuffle, and kept as a
narrow checkpoint; fitting and scoring read only that.  Cosine features of random directions
approximate a Gaussian kernel; each partition sums its share of the normal equations and the
sums of a fixed size meet in a small system that the driver solves.  Isotonic calibration on
a fold left out of the fit, from counts in a fixed number of bins, makes scores probabilities.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packaudit.functions.tables import cut
from packaudit.llm.common import fold, key_type, slices, texts

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
FEATURES = 256
WIDTH = 3.0  # of the kernel, in standard deviations of a statistic
RIDGE = 1.0
BINS = 1024  # calibration bins between margins -1 and 2

# Classes of bytes whose shares of a text are statistics.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "|", "!", "#$%&*@^~<>=+_\\/{}[]", ".,;:?", "'\"()-`")
STATISTICS = (*(f"share_{i}" for i in range(len(CLASSES))), "share_other", "log_bytes", "log_words", "word_bytes", "distinct_words", "log_lines", "distinct_lines", "line_words", "longest_line")

_table = np.zeros((256, len(CLASSES) + 1))
for _i, _chars in enumerate(CLASSES):
    _table[[ord(_c) for _c in _chars], _i] = 1
_table[128:, len(CLASSES)] = 1


def describe(text: str) -> np.ndarray:
    """Statistics of one text; an empty text has zeros throughout."""
    data = text.encode()
    if not data:
        return np.zeros(len(STATISTICS))
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _table / len(data)
    words, lines = data.split(), data.split(b"\n")
    n = max(1, len(words))
    return np.concatenate([shares, [
        math.log1p(len(data)), math.log1p(len(words)), math.log1p(len(data) / n), len(set(words)) / n, math.log1p(len(lines)),
        len(set(lines)) / len(lines), math.log1p(len(words) / len(lines)), max(map(len, lines)) / len(data)]])


def statistics(files: DataFrame) -> DataFrame:
    """(path, stats) per file, from its whole content; null content counts as empty."""

    def run(batches):
        for batch in slices(batches):
            rows = np.array([describe(t) for t in texts(batch)])
            stats = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("path"), stats], ["path", "stats"])

    return files.select("path", "content").mapInArrow(run, f"path {key_type(files)}, stats array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None  # None: nothing to learn from
    knots: np.ndarray
    levels: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(7)
        directions = rng.normal(0, 1 / WIDTH, (rows.shape[1], FEATURES))
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(x @ directions + rng.uniform(0, 2 * np.pi, FEATURES)) * math.sqrt(2 / FEATURES), np.ones((len(rows), 1))])

    def margin(self, rows: np.ndarray) -> np.ndarray:
        return self.features(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), 0.5)
        return np.interp(self.margin(rows), self.knots, self.levels)


def isotonic(x: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in ascending x; (centre, level) of each block."""
    blocks: list[list[float]] = []
    for a, m, w in zip(x, mean, weight):
        blocks.append([a * w, m * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def fit(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on the labels (path, label 0 or 1) of files outside the held-out fold.

    Null labels and labels of unknown paths are left out; a path labelled twice counts twice.
    Without any usable label every score is one half.  Only sums of a fixed size reach the driver.
    """
    known = labels.select("path", F.col("label").cast("double").alias("label")).where("label is not null")
    train = cut(stats.join(known, "path").where(fold("path", FOLDS) != HELD_OUT).select("stats", "label", fold("path", FOLDS).alias("fold")))
    k = len(STATISTICS)
    row = train.agg(F.count("*").alias("n"), *(f(F.col("stats")[i]).alias(f"{name}{i}") for i in range(k) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not row["n"]:
        return QualityModel(np.zeros(k), np.ones(k), None, np.zeros(1), np.zeros(1))
    model = QualityModel(np.array([row[f"m{i}"] for i in range(k)]), np.array([max(row[f"s{i}"], 1e-6) for i in range(k)]), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def partial(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in slices(batches, 4096):
            x = model.features(np.array(batch.column("stats").to_pylist()))
            total += x.T @ np.column_stack([x, batch.column("label").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    def add(key, table):
        sums = np.sum(np.array(table["sums"].to_pylist()), axis=0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([sums], pa.list_(pa.float64()))})

    fitted = train.where(F.col("fold") != CALIBRATION).mapInArrow(partial, "i int, sums array<double>").groupBy("i").applyInArrow(add, "i int, sums array<double>")
    sums = np.array([r["sums"] for r in fitted.orderBy("i").collect()])
    gram, target = sums[:, :-1], sums[:, -1]
    model.weights = np.linalg.solve(gram + RIDGE * np.diag([*[1.0] * FEATURES, 1e-9]) + 1e-9 * np.eye(len(gram)), target)

    def margins(batches):
        for batch in slices(batches, 4096):
            m = model.margin(np.array(batch.column("stats").to_pylist()))
            bins = np.clip((m + 1) / 3 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("label"), pa.array(m)], ["bin", "label", "margin"])

    binned = train.where(F.col("fold") == CALIBRATION).mapInArrow(margins, "bin int, label double, margin double")
    bins = binned.groupBy("bin").agg(F.avg("margin").alias("x"), F.avg("label").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if bins:
        model.knots, model.levels = isotonic(*(np.array([r[c] for r in bins], float) for c in ("x", "y", "n")))
    else:  # too few labels to calibrate: the margin itself, kept between 0 and 1
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(path, score) per row of the statistics: the calibrated chance of label 1, from 0 to 1."""

    def run(batches):
        for batch in slices(batches, 4096):
            rows = np.array(batch.column("stats").to_pylist()).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(model.score(rows))], ["path", "score"])

    return stats.select("path", "stats").mapInArrow(run, f"path {key_type(stats)}, score double")


def rate(files: DataFrame, labels: DataFrame) -> DataFrame:
    """(path, held_out, score) per file: statistics, fit on labels (path, label), scores.

    One row per input row; repeated and null paths keep their rows (a null path has no label
    and belongs to the held-out fold).  Other columns are not read.
    """
    stats = cut(statistics(files))
    out = score(stats, fit(stats, labels))
    return out.select("path", (fold("path", FOLDS) == HELD_OUT).alias("held_out"), "score")


def accept(files: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The files, all columns, whose score reaches the threshold.

    Fit as in ``rate``; the texts are then scored where they lie, so nothing wide is shuffled.
    """
    model = fit(cut(statistics(files)), labels)

    def run(batches):
        for batch in slices(batches):
            kept = model.score(np.array([describe(t) for t in texts(batch)]).reshape(batch.num_rows, len(STATISTICS))) >= threshold
            yield batch.filter(pa.array(kept))

    return files.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in files.schema.fields]))
