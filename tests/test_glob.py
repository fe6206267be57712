import fnmatch
import random

from pyspark.sql import functions as F

from packaudit.functions import columns as c


def test_globs_equal_fnmatch(spark):
    """Random texts and patterns over few letters, so that many of them fit."""
    rng = random.Random(2)
    word = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
    rows = [(word("ab/.é", 9), word("ab/.é**", 7)) for _ in range(4000)] + [(word("ab/.", 5), word("ab/.*?[a]", 6)) for _ in range(1500)]
    rows += [("", ""), ("", "*"), ("", "**"), ("a", ""), ("aba", "ab*ba"), ("abba", "ab*ba"), ("a\nb", "a*b"), ("data/f1.csv", "data/*"), ("x.data/f", "data/*"), ("a+b(c)", "a+*(c)"), ("$x", "$*")]
    plain = lambda p: "[" not in p or all(part[:2] == "a]" for part in p.split("[")[1:])
    rows = [r for r in rows if plain(r[1])]
    got = spark.createDataFrame(rows, "t string, p string").select("t", "p", c.matches_glob(F.col("t"), F.col("p")).alias("fits")).collect()
    assert [(r.t, r.p) for r in got if r.fits != fnmatch.fnmatchcase(r.t, r.p)] == []
    assert 300 < sum(r.fits for r in got) < len(got) - 300


def test_stars_need_no_regular_expression(spark):
    """A long text against many stars takes no backtracking."""
    df = spark.createDataFrame([("a" * 20_000, "*a" * 40 + "*b")], "t string, p string")
    assert df.select(c.matches_glob(F.col("t"), F.col("p"))).first()[0] is False
