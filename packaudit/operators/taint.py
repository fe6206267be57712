"""Sensitive data followed through declared steps to network sinks and start-up files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit.functions import columns as c
from packaudit.functions import fixed
from packaudit.functions.tables import cut, first_rows, union_all
from packaudit.operators.contracts import step_script
from packaudit.operators.reach import closure, inherit_labels, roots


def taint_label(detail: Column, strict: bool = False) -> Column:
    """Label of a sensitive read.  ``strict`` tests secret words only on environment entries."""
    name = F.regexp_replace(detail, "^env:", "")
    env = c.is_secret_env(name, bounded=False)
    if strict:
        env = env & detail.startswith("env:")
    label = F.when(env, "env_secret")
    for pattern, value in fixed.TAINT_PATHS:
        label = label.when(c.matches(detail, pattern), value)
    return label.otherwise("unknown_sensitive")


def label_bit(label: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), c.ranked(label, fixed.TAINT_LABELS))


def bits_to_labels(bits: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(fixed.TAINT_LABELS)]))


def step_upstream(steps: DataFrame) -> DataFrame:
    """Edges from a step to those it takes data from: named outputs, else the step before.

    Only earlier steps count.  A step without references inherits from the one before it
    when that one produces an output.
    """
    index = steps.select("skill_id", F.col("step_id").alias("ref_id"), F.col("step_index").alias("up_index"))
    refs = steps.select("skill_id", "step_index", F.explode("input_refs").alias("ref")).withColumn("ref_id", F.substring_index("ref", ".", 1))
    named = refs.join(index, ["skill_id", "ref_id"]).filter("up_index < step_index").select("skill_id", "step_index", "up_index")
    before = steps.select("skill_id", (F.col("step_index") + 1).alias("step_index"), F.col("step_index").alias("up_index"), "output_name")
    plain = steps.filter(F.size("input_refs") == 0).select("skill_id", "step_index").join(
        before.filter("output_name <> ''"), ["skill_id", "step_index"]).select("skill_id", "step_index", "up_index")
    return named.unionByName(plain).distinct()


def step_seeds(linked: DataFrame, script_io: DataFrame, strict: bool = False) -> DataFrame:
    """Sensitive reads of each step's script, labelled."""
    reads = script_io.filter("kind = 'sensitive_read'").select("skill_id", F.col("path").alias("script"), "detail").distinct()
    return linked.select("skill_id", "step_index", "script").join(reads, ["skill_id", "script"]).withColumn(
        "label", taint_label(F.col("detail"), strict))


def blocked_steps(linked: DataFrame, script_io: DataFrame, flags: DataFrame) -> DataFrame:
    """Steps whose script is analysable and gives nothing out: data ends there."""
    out = script_io.filter("kind = 'output' and subtype in ('stdout', 'file_write')").select("skill_id", F.col("path").alias("script")).distinct()
    clear = flags.filter("analyzability >= 0.5").select("skill_id", F.col("path").alias("script"))
    return (linked.filter("output_name = ''").join(clear, ["skill_id", "script"], "left_semi")
            .join(out, ["skill_id", "script"], "left_anti").select("skill_id", "step_index"))


def taint_map(steps: DataFrame, seeds: DataFrame, blocked: DataFrame) -> DataFrame:
    """Labels that leave each step: its own and those of all steps upstream.

    Straight runs of steps inherit by doubling, in rounds that grow with the logarithm of
    their length.  Only what enters steps with several upstream steps goes by frontier, over
    the heads of the runs.
    """
    key = ["skill_id", "step_index"]
    own = seeds.groupBy(*key).agg(F.bit_or(label_bit(F.col("label"))).alias("bits"))
    stop = blocked.select(*key).distinct()
    edges = cut(step_upstream(steps).join(stop.withColumnRenamed("step_index", "up_index"), ["skill_id", "up_index"], "left_anti"))
    ups = edges.groupBy(*key).agg(F.min("up_index").alias("up"), F.count("*").alias("n"))
    nodes = cut(steps.select(*key).distinct().join(own, key, "left").join(ups, key, "left").select(
        "skill_id", F.col("step_index").alias("id"), F.when(F.col("n") == 1, F.col("up")).alias("up_id"),
        F.coalesce("bits", F.lit(0)).alias("bits"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("merges")))
    got = inherit_labels(nodes)
    merging = cut(edges.join(nodes.filter("merges").select("skill_id", F.col("id").alias("step_index")), key))
    if not merging.isEmpty():
        heads = roots(nodes)
        entering = cut(merging.join(got.withColumnRenamed("id", "up_index"), ["skill_id", "up_index"]).join(
            heads.withColumnRenamed("id", "up_index"), ["skill_id", "up_index"]))
        labelled = entering.select("skill_id", F.col("step_index").alias("id"), F.explode(bits_to_labels(F.col("bits"))).alias("label"))
        reached = closure(labelled, entering.select("skill_id", F.col("root").alias("from_id"), F.col("step_index").alias("to_id")), carry=("label",))
        more = reached.groupBy("skill_id", F.col("id").alias("root")).agg(F.bit_or(label_bit(F.col("label"))).alias("more"))
        got = got.join(heads, ["skill_id", "id"]).join(more, ["skill_id", "root"], "left").select(
            "skill_id", "id", F.col("bits").bitwiseOR(F.coalesce("more", F.lit(0))).alias("bits"))
    got = got.withColumnRenamed("id", "step_index").join(stop.withColumn("stop", F.lit(True)), key, "left")
    left = F.when(F.col("stop"), 0).otherwise(F.col("bits"))
    return got.select("skill_id", "step_index", left.alias("bits"), bits_to_labels(left).alias("labels"))


def origin_reach(steps: DataFrame, seeds: DataFrame, blocked: DataFrame) -> DataFrame:
    """Steps each seeded step's data gets to, the seeded step itself included."""
    edges = step_upstream(steps).select("skill_id", F.col("up_index").alias("from_id"), F.col("step_index").alias("to_id"))
    passing = edges.join(blocked.select("skill_id", F.col("step_index").alias("from_id")), ["skill_id", "from_id"], "left_anti")
    origins = seeds.select("skill_id", F.col("step_index").alias("id")).distinct().withColumn("origin", F.col("id"))
    return closure(origins, passing, carry=("origin",)).select("skill_id", "origin", F.col("id").alias("step_index"))


def taint_chains(steps: DataFrame, purpose: DataFrame, script_io: DataFrame, flags: DataFrame, strict: bool = False) -> DataFrame:
    """Flows from a sensitive read to a network effect or a start-up file, one per label, detail and sink."""
    linked = step_script(steps, flags)
    seeds = step_seeds(linked, script_io, strict)
    reach = origin_reach(steps, seeds, blocked_steps(linked, script_io, flags))
    said = c.has_word(F.col("description"), fixed.NETWORK_DECLARING_WORDS) | c.has_word(F.coalesce("purpose", F.lit("")), fixed.NETWORK_DECLARING_WORDS)
    sites = linked.join(purpose.select("skill_id", "purpose"), "skill_id", "left").select(
        "skill_id", "step_index", "script", said.alias("said"))
    io = script_io.select("skill_id", F.col("path").alias("script"), "kind", "subtype", F.col("detail").alias("sink_detail"))
    acts = sites.join(io, ["skill_id", "script"])
    net = acts.filter("kind = 'effect' and subtype = 'network_request'").select(
        "skill_id", "step_index", "script", "said", "sink_detail",
        F.when(F.lower("sink_detail").contains("post"), "network_post").otherwise("network_get").alias("sink_type"), F.lit(0).alias("o"))
    keep = acts.filter((F.col("kind") == "output") & (F.col("subtype") == "file_write") & c.is_startup_file(F.col("sink_detail"))).select(
        "skill_id", "step_index", "script", F.lit(False).alias("said"), "sink_detail", F.lit("file_write").alias("sink_type"), F.lit(1).alias("o"))
    sinks = net.unionByName(keep).distinct()
    named = seeds.select("skill_id", F.col("step_index").alias("origin"), F.col("script").alias("origin_script"), "label", "detail")
    flows = sinks.join(reach, ["skill_id", "step_index"]).join(named, ["skill_id", "origin"])
    flows = first_rows(flows, ["skill_id", "label", "detail", "sink_detail", "script"], [F.col("step_index"), F.col("o"), F.col("origin")])
    hot = F.col("label").isin(fixed.CRITICAL_TAINT_LABELS) & (F.col("sink_type") != "file_write")
    flows = flows.withColumn("severity", F.when(hot, "CRITICAL").otherwise("HIGH"))
    return step_path(flows, steps).select(
        "skill_id", "label", "detail", "origin_script", F.concat(F.lit("S"), "origin").alias("origin_step"), "sink_type", "sink_detail",
        F.col("script").alias("dest_script"), F.concat(F.lit("S"), "step_index").alias("dest_step"), "step_path", "scripts", "severity",
        F.col("said").alias("declared"))


def step_path(flows: DataFrame, steps: DataFrame) -> DataFrame:
    """Add the steps from ``origin`` to ``step_index`` in order and the scripts they name.

    A package's program is a short list of steps, so each flow slices that list: no range
    join, and no row per (flow, step).
    """
    program = steps.groupBy("skill_id").agg(F.array_sort(F.collect_list(F.struct("step_index", "step_id", "target_script"))).alias("program"))
    j = flows.join(program, "skill_id", "left")
    part = F.filter("program", lambda s: (s["step_index"] >= F.col("origin")) & (s["step_index"] <= F.col("step_index")))
    return j.withColumns({
        "step_path": F.transform(part, lambda s: s["step_id"]),
        "scripts": F.filter(F.transform(part, lambda s: s["target_script"]), lambda t: t != ""),
    }).drop("program")
