"""Attack-chain stages per script, package and step text, and the chains they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit.functions import columns as c
from packaudit.functions import fixed
from packaudit.functions.tables import first_rows, union_all, written
from packaudit.operators.contracts import steps_for_script


def stage_array() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(s), F.lit(s)) for s in fixed.STAGES]))


def _complete(df: DataFrame, present: dict[str, Column], keys: list[str]) -> DataFrame:
    flags = {s: F.coalesce(F.bool_or(present[s]), F.lit(False)) if s in present else F.lit(False) for s in fixed.STAGES}
    return df.groupBy(*keys).agg(*[e.alias(s) for s, e in flags.items()])


def stages_per_script(script_io: DataFrame, flags: DataFrame) -> DataFrame:
    """Stage flags of each script from its reads, effects, outputs and file flags."""
    keys = ["skill_id", "path"]
    facts = script_io.select(*keys, "kind", "subtype", F.lower("detail").alias("d"), F.lit(False).alias("packed"), F.lit(False).alias("dyn"))
    files = flags.select(*keys, F.lit("flag").alias("kind"), F.lit("").alias("subtype"), F.lit("").alias("d"),
                         (F.col("has_encoded_payloads") | F.col("has_obfuscation")).alias("packed"), F.col("has_dynamic_execution").alias("dyn"))
    kind, sub, d = F.col("kind"), F.col("subtype"), F.col("d")
    process = (kind == "effect") & (sub == "subprocess")
    lasting = c.has_any(d, fixed.STAGE_WORDS["persistence"])
    present = {
        "access": (kind == "sensitive_read") & c.has_any(d, fixed.STAGE_WORDS["access"]),
        "exfiltration": (kind == "effect") & (sub == "network_request"),
        "command": process | F.col("dyn"),
        "persistence": (process | (kind == "output")) & lasting,
        "staging": F.col("packed"),
    }
    out = _complete(facts.unionByName(files), present, keys)
    return out.withColumn("stages", stage_array()).filter(F.size("stages") > 0)


def stages_from_text(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Stage flags from words in raw text, which is put in lower case once."""
    flags = c.let(F.lower(text), lambda low: F.struct(*[c.has_any(low, w).alias(s) for s, w in fixed.STAGE_WORDS.items()]))
    return texts.select(*keys, flags.alias("f")).select(*keys, "f.*").withColumn("stages", stage_array())


def stages_from_steps(steps: DataFrame) -> DataFrame:
    """Stages a package's step texts describe; at least two, and a stricter list for sending."""
    low = F.lower("description")
    present = {s: c.has_any(low, fixed.STAGE_WORDS[s]) for s in ("access", "persistence", "staging", "command")}
    present["exfiltration"] = c.has_any(low, fixed.STEP_EXFIL_WORDS)
    return _complete(steps, present, ["skill_id"]).withColumn("stages", stage_array()).filter(F.size("stages") >= 2)


def classify_chain() -> Column:
    """Type and severity of a stage combination; the most telling combination first."""
    s = F.col
    kind = lambda name, sev: F.struct(F.lit(name).alias("chain_type"), F.lit(sev).alias("severity"))
    theft = s("access") & s("exfiltration")
    return (
        F.when(theft & s("persistence"), kind("apt_style_attack", "CRITICAL"))
        .when(theft & s("staging"), kind("credential_exfil_with_encoding", "CRITICAL"))
        .when(theft, kind("credential_exfiltration", "CRITICAL"))
        .when(s("persistence") & s("command"), kind("persistence_via_execution", "HIGH"))
        .when(s("discovery") & s("exfiltration"), kind("recon_exfiltration", "HIGH"))
        .when(s("command") & s("exfiltration"), kind("c2_callback", "HIGH"))
        .when(s("lateral") & s("access"), kind("lateral_movement", "HIGH"))
        .when(s("staging") & s("exfiltration"), kind("staged_exfiltration", "MEDIUM"))
        .otherwise(kind("unknown_chain", "LOW")))


def package_stages(per_script: DataFrame) -> DataFrame:
    out = per_script.groupBy("skill_id").agg(*[F.bool_or(s).alias(s) for s in fixed.STAGES], F.count("*").alias("n_scripts"))
    return out.withColumn("stages", stage_array())


def _shape(df: DataFrame, prefix: str, text: Column, scripts: Column, n_scripts: Column, n_steps: Column, confidence: float) -> DataFrame:
    return df.select(
        "skill_id", F.concat(F.lit(prefix), "k.chain_type").alias("chain_type"), F.array_sort("stages").alias("stages"), F.col("k.severity").alias("severity"),
        text.alias("description"), scripts.alias("script"), n_scripts.cast("long").alias("n_scripts"), n_steps.cast("long").alias("n_steps"),
        F.lit(confidence).alias("confidence"), (F.col("access") & F.col("exfiltration")).alias("complete"))


def attack_chains(script_io: DataFrame, flags: DataFrame, steps: DataFrame) -> DataFrame:
    """Chains inside one script, across the scripts of a package, and told by the steps.

    A chain row carries counts; its member scripts are the rows of ``stages_per_script`` for
    that package, so a package with very many scripts never becomes one long list.
    """
    # One narrow row per script; four ways of reading it follow.
    per_script = written(stages_per_script(script_io, flags), "script_stages")
    listed = F.array_join(F.array_sort("stages"), ", ")
    strong = F.col("k.severity").isin("CRITICAL", "HIGH")
    typed = per_script.withColumn("k", classify_chain())
    inside = typed.withColumn("intra", (F.size("stages") >= 2) & strong)
    named = written(steps_for_script(per_script, steps), "script_steps")
    links = named.select("skill_id", "path", F.size("step_list").alias("linked"))
    one = inside.filter("intra").join(links, ["skill_id", "path"], "left")
    intra = _shape(one, "intra_script_", F.concat(F.lit("Script '"), "path", F.lit("' implements "), F.size("stages").cast("string"),
                   F.lit(" kill chain stages in single file: "), listed), F.col("path"), F.lit(1), F.coalesce("linked", F.lit(0)), 0.8)
    pkg = inside.groupBy("skill_id").agg(
        *[F.bool_or(s).alias(s) for s in fixed.STAGES], F.count("*").alias("n_scripts"), F.bool_or(~F.col("intra")).alias("fresh"))
    pkg = pkg.withColumn("stages", stage_array()).withColumn("k", classify_chain()).filter(strong & (F.size("stages") >= 2) & F.col("fresh") & (F.col("n_scripts") >= 2))
    told = named.select("skill_id", F.explode("step_list").alias("i")).distinct().groupBy("skill_id").agg(F.count("*").alias("linked"))
    pkg = pkg.join(told, "skill_id", "left")
    spread = _shape(pkg, "distributed_", F.concat(F.lit("Distributed kill chain across "), F.col("n_scripts").cast("string"), F.lit(" scripts: "), listed),
                    F.lit(""), F.col("n_scripts"), F.coalesce("linked", F.lit(0)), 0.7)
    told = stages_from_steps(steps).withColumn("k", classify_chain()).filter(strong)
    told = told.join(steps.groupBy("skill_id").agg(F.count("*").alias("n_steps")), "skill_id")
    nl = _shape(told, "nl_described_", F.concat(F.lit("NL pipeline description implies a suspicious workflow: "), listed), F.lit(""), F.lit(0), F.col("n_steps"), 0.6)
    return union_all([intra, spread, nl])


def chain_evidence(chains: DataFrame, script_io: DataFrame, reads: int | None = None, effects: int | None = None) -> DataFrame:
    """Sensitive reads and effects of each script that holds a whole chain, one row each.

    ``kind`` is read or effect and rows are ordered by ``pos``; ``reads`` and ``effects`` keep
    only the first ones of a script, as a report shows them.
    """
    hot = chains.filter("script <> ''").select("skill_id", F.col("script").alias("path"), F.array_contains("stages", "access").alias("access")).distinct()
    io = script_io.join(hot, ["skill_id", "path"])
    order = [F.col("pos"), F.col("detail")]
    seen = first_rows(io.filter("kind = 'sensitive_read' and access"), ["skill_id", "path"], order, reads).select(
        "skill_id", "path", F.lit("read").alias("kind"), "line", "pos", F.col("detail").alias("fragment"))
    acts = first_rows(io.filter("kind = 'effect'"), ["skill_id", "path"], order, effects).select(
        "skill_id", "path", F.lit("effect").alias("kind"), "line", "pos", F.concat("subtype", F.lit(": "), F.substring("detail", 1, 60)).alias("fragment"))
    return seen.unionByName(acts)
