"""Mixing sources to target weights by Poisson replication.

Every source gets a mean number of repetitions that brings its share of the mixture to its
target; each file draws its own number by inverting the Poisson distribution at a uniform
value hashed from its key, so a rerun or a lost executor draws the same.  Files are repeated
before one shuffle by a hash of (file, copy), which mixes the corpus globally and deals even
a source that holds most rows evenly.  All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit.functions.tables import cut

SEED = "mix-1"
BROADCAST = 1_000_000  # values of all distributions together up to which they are sent to every task
RESULT = ("copy", "mix_key")


def uniform(*parts: Column | str) -> Column:
    """A value in [0, 1) from the first 52 bits of an MD5 digest."""
    text = F.concat_ws(":", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def tempered(files: DataFrame, source: str, power: float = 0.5) -> DataFrame:
    """Targets (source, weight) with weight = size ** power: small sources are drawn up, large ones down."""
    return files.groupBy(F.col(source).alias("source")).agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))


def repetition_rates(files: DataFrame, targets: DataFrame, source: str, scale: float = 1.0) -> DataFrame:
    """(source, rate, cdf) for every source with rows: mean repetitions of its files so that the
    mixture has ``scale`` times the rows of the input and sources share it by weight.

    Sources without a positive weight get rate 0.  ``cdf`` is the cumulative Poisson
    distribution up to where what is left is below double precision; it is summed from log
    probabilities, so large rates do not underflow.
    """
    sizes = files.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    wanted = targets.select(F.col("source").alias("_source"), F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("weight")).groupBy("_source").agg(F.sum("weight").alias("weight"))
    both = sizes.join(wanted, sizes["source"].eqNullSafe(wanted["_source"]), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = both.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_n") * F.lit(scale) / F.col("n")).otherwise(0.0)
    rates = both.join(F.broadcast(total), F.lit(True)).select("source", rate.alias("rate"))  # total: one row
    last = F.ceil(F.col("rate") + 10 * F.sqrt("rate") + 20).cast("int")
    start = F.struct((-F.col("rate")).alias("l"), F.exp(-F.col("rate")).alias("sum"), F.array(F.exp(-F.col("rate"))).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        l = acc["l"] + F.log(F.col("rate") / k)
        s = acc["sum"] + F.exp(l)
        return F.struct(l.alias("l"), s.alias("sum"), F.concat(acc["cdf"], F.array(s)).alias("cdf"))

    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))
    return rates.select("source", "rate", cdf.alias("cdf"))


def mix(files: DataFrame, targets: DataFrame, source: str = "skill_id", scale: float = 1.0, seed: str = SEED) -> DataFrame:
    """The files, each repeated as often as it drew, in a globally mixed order.

    All columns stay; ``copy`` counts the repetitions of a file from 1 and ``mix_key`` is the
    sort key of the order within partitions (input columns of these names are replaced).  Files
    with the same path and source draw the same number; a null path draws as an empty one; a
    null source is a source of its own.  Files that draw zero, and sources without a positive
    weight, are not in the mixture.  Empty tables, and targets without any weight, give no rows.
    """
    files = files.drop(*RESULT)
    rates = repetition_rates(files, targets, source, scale).select(F.col("source").alias("_mix_source"), F.col("cdf").alias("_mix_cdf"))
    # The rates are one row per source.  Few enough values are broadcast, so texts are not shuffled by
    # source; else they are joined by shuffle, where adaptive execution splits a hot source.
    rates = cut(rates)
    if (rates.agg(F.sum(F.size("_mix_cdf") + 1)).first()[0] or 0) <= BROADCAST:
        rates = F.broadcast(rates)
    drawn = files.join(rates, files[source].eqNullSafe(F.col("_mix_source")))
    # How many values of the distribution lie below the uniform one: its place among them.
    times = F.array_position(F.array_sort(F.array_append("_mix_cdf", F.col("_mix_u"))), F.col("_mix_u")).cast("int") - 1
    drawn = drawn.withColumn("_mix_u", uniform(F.lit(seed), "path")).withColumn("_mix_n", times).where("_mix_n > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n"))))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("path").cast("string"), F.lit("")), F.col("copy").cast("string")).cast("binary")))
    return keyed.drop("_mix_source", "_mix_cdf", "_mix_u", "_mix_n").repartition("mix_key").sortWithinPartitions("mix_key")
