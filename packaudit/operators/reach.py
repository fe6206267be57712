"""Reachability over edge tables: closure by frontier, pointer doubling on single-parent chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packaudit.functions.tables import cut


def closure(seeds: DataFrame, edges: DataFrame, max_rounds: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Nodes reached from ``seeds`` over ``edges`` with the round each was first reached.

    ``seeds`` has skill_id, id and the ``carry`` columns, which travel along; ``edges`` has
    skill_id, from_id, to_id.  Each round joins only the newly reached nodes, and an anti
    join keeps cycles from running on.  Every round is checkpointed, so plans stay short.
    """
    key = ["skill_id", "id", *carry]
    links = edges.select("skill_id", F.col("from_id").alias("id"), "to_id").distinct()
    links = cut(links)
    frontier = cut(seeds.select(*key).distinct().withColumn("depth", F.lit(0)))
    reached, rounds = frontier, 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        step = frontier.join(links, ["skill_id", "id"]).select(
            "skill_id", F.col("to_id").alias("id"), *carry).distinct()
        frontier = cut(step.join(reached.select(*key), key, "left_anti").withColumn("depth", F.lit(rounds)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if rounds % 8 == 0:
            reached = cut(reached)
    return reached


def inherit_labels(nodes: DataFrame, label_bits: str = "bits") -> DataFrame:
    """Union of label bits over a node and everything above it, for single-parent chains.

    ``nodes`` has skill_id, id, up_id (null where nothing is inherited) and the bits a node
    adds.  Each round doubles the distance covered, so a chain of n nodes takes about
    log2(n) rounds of an evenly spread equi-join on (skill_id, id), however long it is.
    """
    state = cut(nodes.select("skill_id", "id", F.col("up_id").alias("up"), F.col(label_bits).alias("bits")))
    while not state.filter("up is not null").isEmpty():
        above = state.select("skill_id", F.col("id").alias("up"), F.col("up").alias("next_up"), F.col("bits").alias("up_bits"))
        state = cut(state.join(above, ["skill_id", "up"], "left").select(
            "skill_id", "id", F.col("next_up").alias("up"),
            F.col("bits").bitwiseOR(F.coalesce("up_bits", F.lit(0))).alias("bits")))
    return state.select("skill_id", "id", "bits")


def follow_within(ops: DataFrame, is_source: Column, is_target: Column, k: int, carry: list[Column],
                  keys: tuple[str, ...] = ("skill_id", "path"), order: tuple[str, ...] = ("line", "pos")) -> DataFrame:
    """Source rows followed by a target within the next ``k`` rows of the same file.

    The nearest such target is reported.  The window runs inside one file, so its partitions
    are as small as files are.
    """
    return ops.withColumn("target", next_within(is_target, k, carry, keys, order)).filter(is_source & F.col("target").isNotNull())


def next_within(is_target: Column, k: int, carry: list[Column], keys: tuple[str, ...] = ("skill_id", "path"), order: tuple[str, ...] = ("line", "pos")) -> Column:
    """The nearest target within the next ``k`` rows of the same file, null where there is none.

    Several of these over the same keys and order take one shuffle and one sort.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, k)
    return F.first(F.when(is_target, F.struct(*carry)), ignorenulls=True).over(w)


def nearest_targets(sources: DataFrame, targets: DataFrame, edges: DataFrame, k: int, carry: list[str]) -> DataFrame:
    """For each source the nearest target within ``k`` edges, where there is one.

    ``sources`` has skill_id, id; ``targets`` has skill_id, id and the ``carry`` columns, by
    which, and then by id, equally near targets are ordered; ``edges`` has skill_id, from_id,
    to_id and may branch, join and run in circles.  Returns skill_id, id, depth and the struct
    ``target`` of the carried columns and the target's id.

    The search runs from all targets at once, against the edges: the first round that comes to
    a node gives it its distance and its first target, and later ones pass it by.  So a node
    has one label however many sources lie behind it, and a hub is never multiplied by them.
    A source that is a target itself is no hit of its own unless a circle leads back to it.
    """
    links = cut(edges.select("skill_id", "from_id", "to_id").distinct())
    label = F.struct(*carry, "id").alias("target")
    frontier = cut(targets.select("skill_id", "id", label).groupBy("skill_id", "id").agg(F.min("target").alias("target")))
    seen = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, k):
        if frontier.isEmpty():
            break
        back = frontier.withColumnRenamed("id", "to_id").join(links, ["skill_id", "to_id"]).groupBy("skill_id", F.col("from_id").alias("id")).agg(F.min("target").alias("target"))
        frontier = cut(back.join(seen.select("skill_id", "id"), ["skill_id", "id"], "left_anti"))
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
        if depth % 8 == 0:
            seen = cut(seen)
    ahead = seen.select("skill_id", F.col("id").alias("to_id"), F.struct((F.col("depth") + 1).alias("depth"), "target").alias("way"))
    first = sources.select("skill_id", "id").distinct().join(links.withColumnRenamed("from_id", "id"), ["skill_id", "id"]).join(ahead, ["skill_id", "to_id"])
    return first.groupBy("skill_id", "id").agg(F.min("way").alias("way")).select("skill_id", "id", "way.depth", "way.target")


def roots(nodes: DataFrame) -> DataFrame:
    """Head of the chain each node stands in, by pointer doubling; ``up_id`` is null at heads."""
    state = cut(nodes.select("skill_id", "id", F.coalesce("up_id", "id").alias("root")))
    while True:
        above = state.select("skill_id", F.col("id").alias("root"), F.col("root").alias("higher"))
        state = cut(state.join(above, ["skill_id", "root"], "left").select(
            "skill_id", "id", F.coalesce("higher", "root").alias("root"), (F.coalesce("higher", "root") != F.col("root")).alias("moved")))
        if state.filter("moved").isEmpty():
            return state.drop("moved")
        state = state.drop("moved")
