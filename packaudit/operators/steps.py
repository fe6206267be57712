"""Declared steps: numbered items of the instruction file and what each one says."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packaudit.functions import columns as c
from packaudit.functions import fixed


def step_texts(manifest: DataFrame) -> DataFrame:
    """Numbered items; else the scripts the body mentions; else one step for the whole package."""
    items = c.all_matches(F.col("body"), fixed.STEP_ITEM)
    refs = c.all_matches(F.col("body"), c.rx(fixed.SCRIPT_AFTER_VERB))

    def tag(a: Column, kind: str) -> Column:
        return F.transform(a, lambda t: F.struct(F.lit(kind).alias("kind"), F.trim(t).alias("text")))

    whole = F.array(F.struct(F.lit("whole").alias("kind"), F.when(
        F.col("purpose") == "", "Execute skill").otherwise(F.col("purpose")).alias("text")))
    chosen = F.when(F.size(items) > 0, tag(items, "item")).when(F.size(refs) > 0, tag(refs, "script")).otherwise(whole)
    rows = manifest.select("skill_id", chosen.alias("all"))
    return rows.select(
        "skill_id", F.size("all").alias("n_steps"), F.posexplode("all").alias("pos", "s")
    ).select("skill_id", "n_steps", (F.col("pos") + 1).alias("step_index"), "s.kind", "s.text")


def step_script(text: Column) -> Column:
    """Script after a verb such as run or call, else a script path in back-ticks."""
    return F.coalesce(c.first_match(text, c.rx(fixed.SCRIPT_AFTER_VERB)),
                      c.first_match(text, fixed.SCRIPT_IN_TICKS), F.lit(""))


def step_action(text: Column) -> Column:
    """First action verb among the first three words."""
    verbs = F.filter(F.slice(c.words(F.lower(text)), 1, 3), lambda w: w.isin(fixed.ACTION_VERBS))
    return F.coalesce(F.get(verbs, F.lit(0)), F.lit("other"))


def step_inputs(text: Column, index: Column) -> Column:
    """Outputs a step refers to: a named step, the previous one, or a data-flow phrase."""
    ref = c.first_match(text, c.rx(fixed.STEP_REFERENCE))
    previous = F.when(index > 1, F.concat(F.lit("S"), index - 1, F.lit(".output")))
    named = (F.when(ref.startswith("S"), F.concat(ref, F.lit(".output")))
             .when(ref.rlike(r"^\d+$"), F.concat(F.lit("S"), ref, F.lit(".output"))).when(ref.isNotNull(), previous))
    phrase = reduce(lambda a, b: a | b, [c.matches(text, p) for p in fixed.FLOW_PHRASES])
    return F.array_compact(F.array(F.coalesce(named, F.when(phrase, previous))))


def describe_steps(texts: DataFrame) -> DataFrame:
    """Step rows (skill_id, n_steps, step_index, kind, text) to the full step relation."""
    t, i, n = F.col("text"), F.col("step_index"), F.col("n_steps")
    item = F.col("kind") == "item"
    conditional = item & c.matches(t, fixed.STEP_CONDITION)
    sid = lambda k: F.concat(F.lit("S"), k)
    d = texts.withColumns({
        "target_script": F.when(item, step_script(t)).when(F.col("kind") == "script", t).otherwise(""),
        "action": F.when(item, step_action(t)).when(F.col("kind") == "script", "run").otherwise("execute"),
    })
    produces = F.col("action").isin(fixed.PRODUCING_VERBS) | (F.col("target_script") != "")
    produces = F.when(item, produces).otherwise(F.col("kind") == "script")
    low = F.lower(t)
    scope = (F.when(F.col("kind") == "whole", "unknown").when(~item, "").when(low.contains("project"), "project directory")
             .when(low.contains("file"), "files").otherwise(""))
    return d.select(
        "skill_id", "step_index", sid(i).alias("step_id"), "action",
        F.when(F.col("kind") == "script", F.concat(F.lit("Run "), t)).when(item, F.substring(t, 1, 200)).otherwise(t).alias("description"),
        "target_script",
        F.when(item, step_inputs(t, i)).otherwise(c.empty_strings()).alias("input_refs"),
        F.when(produces, F.concat(F.lit("step_"), i, F.lit("_result"))).otherwise("").alias("output_name"),
        scope.alias("declared_scope"),
        F.when(conditional, t).otherwise("").alias("condition"),
        F.when(conditional & (i + 1 <= n), sid(i + 1)).otherwise("").alias("branch_true"),
        F.when(conditional & (i + 2 <= n), sid(i + 2)).otherwise("").alias("branch_false"),
    )


def extract_steps(manifest: DataFrame) -> DataFrame:
    return describe_steps(step_texts(manifest))


def script_links(steps: DataFrame) -> DataFrame:
    """First step that refers to each script name, per package."""
    linked = steps.filter("target_script <> ''").withColumn("basename", c.basename(F.col("target_script")))
    return linked.groupBy("skill_id", "basename").agg(F.min("step_index").alias("step_index"))


def program_summary(steps: DataFrame) -> DataFrame:
    """Per package: number of steps, whether any names a script, all descriptions as one text.

    The steps come from one instruction file of bounded size, so the text is bounded too.
    """
    return steps.groupBy("skill_id").agg(
        F.count("*").alias("n_steps"),
        F.bool_or(F.col("target_script") != "").alias("has_link"),
        F.array_join(F.collect_list("description"), "\n").alias("steps_text"))


def step_order(steps: DataFrame) -> DataFrame:
    """Steps with their place in a breadth-first run from the first one.

    From a step the run goes to its two branches, if it is conditional, and to the step
    after it.  Extracted steps run in their own order; this is for supplied steps, whose
    branches may lead anywhere.  Each round reaches the next level and remembers the way
    there, and ways compare like places in the queue.
    """
    from packaudit.functions.tables import cut

    at = steps.select("skill_id", "step_id", "step_index", "condition", "branch_true", "branch_false")
    after = at.select("skill_id", (F.col("step_index") - 1).alias("step_index"), F.col("step_id").alias("after"))
    ways = F.array(
        F.struct(F.lit("0").alias("rank"), F.when(F.col("condition") != "", F.col("branch_true")).alias("next")),
        F.struct(F.lit("1").alias("rank"), F.when(F.col("condition") != "", F.col("branch_false")).alias("next")),
        F.struct(F.lit("2").alias("rank"), F.col("after").alias("next")))
    links = at.join(after, ["skill_id", "step_index"], "left").select("skill_id", "step_id", F.inline(ways)).filter("next <> ''")
    links = cut(links.join(at.select("skill_id", F.col("step_id").alias("next")), ["skill_id", "next"], "left_semi"))
    first = at.groupBy("skill_id").agg(F.min(F.struct("step_index", "step_id")).alias("f"))
    level = cut(first.select("skill_id", F.col("f.step_id").alias("step_id"), F.lit("").alias("way"), F.lit(0).alias("depth")))
    seen, depth = level, 0
    while not level.isEmpty():
        depth += 1
        found = level.join(links, ["skill_id", "step_id"]).groupBy("skill_id", F.col("next").alias("step_id")).agg(F.min(F.concat("way", "rank")).alias("way"))
        level = cut(found.join(seen.select("skill_id", "step_id"), ["skill_id", "step_id"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(level)
        if depth % 8 == 0:
            seen = cut(seen)
    w = Window.partitionBy("skill_id").orderBy("depth", "way")
    return steps.join(seen, ["skill_id", "step_id"]).withColumn("place", F.row_number().over(w)).drop("depth", "way")


def in_run_order(steps: DataFrame) -> DataFrame:
    """Steps renumbered by ``step_order``; their ids stay."""
    return step_order(steps).withColumn("step_index", F.col("place")).select(*steps.columns)
