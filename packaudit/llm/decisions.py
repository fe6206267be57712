"""Quality rules: statistics of texts and a learned decision list, all in Spark expressions.

Statistics of every whole text are taken in one pass of built-in functions, without a shuffle,
and written as a narrow table.  Sequential covering then grows one rule after the other, a
conjunction of thresholds that covers labelled bad texts and few good ones: each step is one
aggregation of the labelled statistics by bin, of a fixed number of result rows.  A rule is
pruned on rows it was not grown on, and what it covers is set aside before the next one.  The
list becomes ordered conditional expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit.llm.common import fold, stored

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
LEAST_WORDS, MOST_REPEATED = 50, 50  # base rules: words of a text; repeated words in a hundred
PLACE_BITS = 24  # of a window's code hold its place, the others its hash
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("n_words", "word_length", "symbols", "capitals", "marks", "repeated_lines", "repeated_words", "distinct_words", "words_a_line")
FOLDS, PRUNE = 5, 1  # rows of this fold of five prune the rules
CUTS = 64  # candidate thresholds of a measure
CONDITIONS, RULES = 4, 16  # of a rule, of a list, at most
PRECISION = 0.8  # share of bad texts, after Laplace, that a rule must cover


def _window(words: Column, at: Column) -> list[Column]:
    return [F.get(words, at + i) for i in range(3)]


def _repeated(codes: Column, same) -> Column:
    """Of sorted window codes, those that ``same`` as a neighbour."""
    return F.filter(codes, lambda c, i: ((i > 0) & same(c, F.get(codes, i - 1))) | F.coalesce(same(c, F.get(codes, i + 1)), F.lit(False)))


def _covered(places: Column) -> Column:
    """Number of words in three-word windows that start at the given places."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + 2)))))


def statistics(files: DataFrame) -> DataFrame:
    """(path, counts, measures) per file, from its whole content; null content counts as empty.

    Words are runs without white space.  Counts: words; their characters; characters of
    ``#*$%&|<>``; lines with a word that equal an earlier line; words in three-word windows
    found twice or more in the text, the first time included.  Measures are shares of them.
    One row per input row; repeated and null paths stay; other columns are not read.
    """
    low = (1 << PLACE_BITS) - 1
    text = files.select("path", F.coalesce(F.col("content").cast("string"), F.lit("")).alias("text"))
    cut = text.select("path", "text", F.array_remove(F.split("text", SPACES), "").alias("words"), F.filter(F.split("text", "\n"), lambda l: l.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    words, n = F.col("words"), F.size("words")
    starts = F.when(n > 2, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    bytes_ = F.octet_length("text")

    def without(pattern: str) -> Column:
        return F.regexp_replace("text", pattern, "")

    counted = cut.select(
        "path", "words", n.cast("long").alias("n_words"), F.char_length(without(SPACES)).cast("long").alias("word_chars"),
        (bytes_ - F.octet_length(without(SYMBOLS))).cast("long").alias("n_symbols"), (bytes_ - F.octet_length(without("[A-Z]+"))).alias("capitals"),
        (bytes_ - F.octet_length(without(r"[!-/:-@\[-`{-~]+"))).alias("marks"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size(F.array_distinct("words")).alias("distinct"),
        F.sort_array(F.transform(starts, lambda i: F.xxhash64(*_window(words, i)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))).alias("codes"))

    def place(code: Column) -> Column:
        return code.bitwiseAND(F.lit(low)).cast("int")

    # Windows with the same hash lie side by side.
    near = counted.withColumn("again", _repeated(F.col("codes"), lambda a, b: F.shiftright(a.bitwiseXOR(b), PLACE_BITS) == 0)).drop("codes")
    again = F.col("again")

    def differs(code: Column, i: Column) -> Column:
        before = F.get(again, i - 1)
        unlike = reduce(lambda a, b: a | b, [x != y for x, y in zip(_window(words, place(code)), _window(words, place(before)))])
        return (i > 0) & (F.shiftright(code.bitwiseXOR(before), PLACE_BITS) == 0) & unlike

    # Where different windows share a hash, or a text has more words than places, whole windows are sorted.
    clash = (F.col("n_words") > low) | (F.size(F.filter("again", differs)) > 0)
    whole = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *_window(words, i)).alias("w"), i.alias("p"))))
    exact = F.transform(F.array(whole), lambda s: _covered(F.transform(_repeated(s, lambda a, b: a["w"] == b["w"]), lambda x: x["p"])))[0]
    repeated = F.when(clash, exact).otherwise(_covered(F.transform("again", place)))
    rows = near.withColumn("n_repeat_words", repeated.cast("long")).drop("again", "words")

    def share(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double")

    return rows.select("path", *COUNTS, *(m.alias(name) for name, m in zip(MEASURES[1:], (
        share("word_chars", "n_words"), share("n_symbols", "word_chars"), share("capitals", "word_chars"), share("marks", "word_chars"),
        share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("distinct", "n_words"), share("n_words", "n_lines")))))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        m = F.col(self.measure)
        return m > self.threshold if self.above else m <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction of conditions on which a text is rejected."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    """FOIL's gain of bad texts (first of each pair) over good ones."""
    if not after[0]:
        return -math.inf
    return after[0] * (math.log2(after[0] / sum(after)) - math.log2(before[0] / sum(before)))


def _histogram(rows: DataFrame) -> dict[int, dict[int, list[int]]]:
    """measure -> bin -> [bad, good] of grown and [bad, good] of pruning rows: at most CUTS + 1 bins each."""
    kinds = [(prune, bad) for prune in (False, True) for bad in (True, False)]
    cells = rows.select("bad", "prune", F.posexplode("bins").alias("m", "bin")).groupBy("m", "bin").agg(
        *(F.count_if((F.col("prune") == prune) & (F.col("bad") == bad)).alias(f"c{i}") for i, (prune, bad) in enumerate(kinds)))
    out: dict[int, dict[int, list[int]]] = {}
    for r in cells.collect():
        out.setdefault(r["m"], {})[r["bin"]] = [r[f"c{i}"] for i in range(4)]
    return out


def _grown(rows: DataFrame, cuts: list[list[float]]) -> tuple[list[tuple[int, bool, int]], list[list[int]]]:
    """Conditions (measure, above, cut) of one rule, and the counts of rows it covers after each."""
    chosen: list[tuple[int, bool, int]] = []
    covered: list[list[int]] = []
    while len(chosen) < CONDITIONS:
        cells = _histogram(rows)
        total = [sum(c[i] for c in cells.get(0, {}).values()) for i in range(4)]
        if not total[0] or (chosen and not total[1]):
            break
        best = None
        for m, bins in sorted(cells.items()):
            below = [0] * 4
            for k in range(len(cuts[m])):
                below = [a + b for a, b in zip(below, bins.get(k, [0] * 4))]
                for above, c in ((False, below), (True, [t - b for t, b in zip(total, below)])):
                    gain = _gain((total[0], total[1]), (c[0], c[1]))
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, (m, above, k), c
        if best is None:
            break
        chosen.append(best[1])
        covered.append(best[2])
        m, above, k = best[1]
        rows = rows.where(F.col("bins")[m] > k if above else F.col("bins")[m] <= k)
    return chosen, covered


def learn(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules that reject, in order, from labels (path, label: 1 good, 0 bad) of files.

    Files that the base rules reject are not learned from, nor are null labels or labels of
    unknown paths; a path labelled twice counts twice.  A rule is grown by FOIL's gain, pruned
    to the first conditions that separate best on the rows of a fold left out of growing, and
    ends the list if under PRECISION of what it covers is bad.  Candidate thresholds are
    CUTS quantiles of each measure.  Without bad labels there is no rule.
    """
    known = labels.select("path", F.col("label").cast("int").alias("label")).where("label is not null")
    rows = stored(stats.where(~base_failed()).join(known, "path").select((F.col("label") == 0).alias("bad"), (fold("path", FOLDS) == PRUNE).alias("prune"), F.array(*(F.col(m).cast("double") for m in MEASURES)).alias("values")), "labelled")
    found = rows.agg(*(F.percentile_approx(F.col("values")[i], [k / CUTS for k in range(CUTS)], 10_000).alias(f"m{i}") for i in range(len(MEASURES)))).first()
    if found["m0"] is None:
        return []
    cuts = [sorted(set(found[f"m{i}"])) for i in range(len(MEASURES))]

    def bin_of(value: Column, thresholds: list[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t < value))

    bins = F.array(*(bin_of(F.col("values")[i], c) for i, c in enumerate(cuts)))
    left = stored(rows.select("bad", "prune", bins.alias("bins")), "bins")
    rules: list[Rule] = []
    while len(rules) < RULES:
        chosen, covered = _grown(left, cuts)
        if not chosen:
            break

        def worth(counts: list[int]) -> float:
            bad, good = counts[2:] if sum(c[2] + c[3] for c in covered) else counts[:2]
            return (bad - good) / (bad + good) if bad + good else -1.0

        keep = max(range(len(chosen)), key=lambda i: (worth(covered[i]), -i)) + 1
        bad, good = covered[keep - 1][0] + covered[keep - 1][2], covered[keep - 1][1] + covered[keep - 1][3]
        if (bad + 1) / (bad + good + 2) < PRECISION:
            break
        rules.append(Rule(tuple(Condition(MEASURES[m], above, cuts[m][k]) for m, above, k in chosen[:keep])))
        hit = reduce(lambda a, b: a & b, [F.col("bins")[m] > k if above else F.col("bins")[m] <= k for m, above, k in chosen[:keep]])
        left = left.where(~hit)
    return rules


def fired(rules: list[Rule]) -> Column:
    """The first rule that holds, as text; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.column(), F.lit(str(rule))).otherwise(out)
    return out


def judge(files: DataFrame, labels: DataFrame) -> DataFrame:
    """(path, counts, base_failed, kept, rule) per file.

    A file fails the base rules if it has under 50 words or over half of its words stand in
    repeated windows; of the others, ``rule`` is the first learned rule that rejects it, null
    if it is kept.  Null and empty contents have no words and fail.  One row per input row;
    an empty table gives no rows; other columns are not read.
    """
    stats = stored(statistics(files), "statistics")
    rules = learn(stats, labels)
    judged = stats.select("path", *COUNTS, base_failed().alias("base_failed"), F.when(~base_failed(), fired(rules)).alias("rule"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
