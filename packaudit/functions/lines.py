"""Line numbers of pattern matches, in time linear in the text whatever its lines and matches.

The text between matches and the matches themselves are cut apart once, in one scan each, and
their newlines counted.  The line of a match is then a running sum over the matches of its
file: a merge of matches and newlines in the order of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newlines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("int")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """Matches in order as (text of the group, newlines before since the last match, newlines inside)."""
    p, whole = F.lit(pattern), F.lit(0)
    gaps = F.transform(F.split(text, pattern), newlines)
    inside = F.transform(F.regexp_extract_all(text, p, whole), newlines)
    every = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(group)).alias("text"), gaps.alias("before"), inside.alias("inside"))
    return F.filter(every, lambda m: m["text"].isNotNull())  # behind the last match there is one more gap


def with_lines(rows: DataFrame, keys: list[str], before: str = "before", inside: str = "inside", pos: str = "pos", line: str = "line") -> DataFrame:
    """Rows of matches with the line each one starts on, from 1.

    ``keys`` name the file and, where several patterns were looked for, the pattern; ``pos``
    is the number of the match.  Only these short rows are shuffled, by file.
    """
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(line, (F.sum(F.col(before) + F.col(inside)).over(w) - F.col(inside) + 1).cast("int")).drop(*(x for x in (before, inside) if x != line))


def match_lines(files: DataFrame, keys: list[str], pattern: str, group: int = 1, text: str = "content", name: str = "m") -> DataFrame:
    """(keys, pos, name, line) for every match of a pattern in each file's text.

    Only texts with a match are cut apart, which takes three scans.
    """
    rows = files.filter(F.col(text).rlike(pattern)).select(*keys, F.posexplode(found(F.col(text), pattern, group)).alias("pos", "z")).select(*keys, "pos", F.col("z.text").alias(name), F.col("z.before").alias("before"), F.col("z.inside").alias("inside"))
    return with_lines(rows, keys)
