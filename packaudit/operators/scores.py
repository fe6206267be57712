"""Package-level aggregates: flags, severities and the component scores of both analyzers.

Every one is a plain grouped aggregate, so Spark combines rows before the shuffle and a
package that holds much of the data costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit.functions import columns as c
from packaudit.functions import fixed
from packaudit.functions.tables import first_rows

KEY = "skill_id"


def dedupe_findings(df: DataFrame) -> DataFrame:
    """First finding per category, file, line and start of description, in scan order."""
    rows = df.withColumn("head", F.substring("description", 1, 50))
    order = [F.col("pos"), F.col("analyzer"), F.desc(c.severity_rank(F.col("severity"))), F.col("description"), F.col("evidence"), F.desc("confidence")]
    return first_rows(rows, [KEY, "category", "path", "line", "head"], order).drop("head")


def package_flags(flags: DataFrame) -> DataFrame:
    return flags.groupBy(KEY).agg(
        *[F.bool_or(x).alias(x) for x in ("has_obfuscation", "has_encoded_payloads", "has_dynamic_execution")],
        F.avg("analyzability").alias("mean_analyzability"), F.min("analyzability").alias("min_analyzability"),
        F.count("*").alias("n_files"))


def severity_summary(df: DataFrame, key: str = KEY) -> DataFrame:
    """Worst severity, whether it is critical, and the number of rows."""
    top = F.max(c.severity_rank(F.col("severity")))
    return df.groupBy(key).agg(c.severity_name(top).alias("max_severity"), (top == 4).alias("has_critical"), F.count("*").alias("n_findings"))


def code_threat(df: DataFrame, key: str = KEY) -> DataFrame:
    """Worst severity weight plus a small bonus per finding, through a logistic curve."""
    raw = F.max(c.weight_of(F.col("severity"), fixed.SEVERITY_WEIGHT_A)) + F.least(F.lit(0.15), F.count("*") * 0.02)
    return df.groupBy(key).agg(c.logistic(raw, *fixed.SEVERITY_CURVE).alias("code_threat"), F.count("*").alias("n_findings"))


def contract_score(violations: DataFrame) -> DataFrame:
    raw = F.max(c.weight_of(F.col("severity"), fixed.SEVERITY_WEIGHT_A) * F.col("confidence")) + F.least(F.lit(0.1), F.count("*") * 0.03)
    return violations.groupBy(KEY).agg(
        c.logistic(raw, *fixed.SEVERITY_CURVE).alias("contract_score"), F.count("*").alias("n_violations"), F.bool_or(F.col("severity") == "CRITICAL").alias("critical_contract"))


def taint_score(chains: DataFrame) -> DataFrame:
    across = F.least(F.lit(0.15), (F.size("scripts") - 1) * 0.1)
    one = c.weight_of(F.col("severity"), fixed.TAINT_WEIGHT) + across + F.when(F.col("declared"), 0.0).otherwise(0.1)
    leak = F.col("sink_type").isin("network_post", "network_get") & ~F.col("declared")
    return chains.groupBy(KEY).agg(F.least(F.lit(1.0), F.max(one)).alias("taint_score"), F.count("*").alias("n_taint"), F.bool_or(leak).alias("undeclared_exfil"))


def chain_score_a(chains: DataFrame) -> DataFrame:
    top = F.max(c.weight_of(F.col("severity"), fixed.CHAIN_WEIGHT_A, 0.1) * F.col("confidence"))
    return chains.groupBy(KEY).agg(
        F.least(F.lit(1.0), top + F.least(F.lit(0.2), F.count("*") * 0.05)).alias("chain_score"), F.bool_or("complete").alias("complete_chain"))


def chain_score_b(chains: DataFrame) -> DataFrame:
    top = F.max(c.weight_of(F.col("severity"), fixed.CHAIN_WEIGHT_B, 0.30))
    return chains.groupBy(KEY).agg(F.least(F.lit(1.0), top + F.least(F.lit(0.10), 0.03 * (F.count("*") - 1))).alias("chain_score"))


def check_score(df: DataFrame) -> DataFrame:
    high = F.count_if(F.col("severity").isin("CRITICAL", "HIGH"))
    top = F.max(c.weight_of(F.col("severity"), fixed.CHECK_WEIGHT, 0.05))
    return df.groupBy(KEY).agg(F.least(F.lit(1.0), top + 0.05 * F.greatest(F.lit(0), high - 1)).alias("check_score"))


def filtered_score(df: DataFrame) -> DataFrame:
    """Worst finding after review: refuted ones count nothing, unreviewed ones half."""
    base = c.weight_of(F.col("severity"), fixed.FILTERED_WEIGHT, 0.05)
    w = F.when(F.col("verified").isNull(), base * 0.5).when(F.col("verified"), base).otherwise(0.0)
    return df.groupBy(KEY).agg(F.max(w).alias("filtered_score"))


def static_overall(pattern: Column, behaviour: Column, chain: Column, alignment: Column) -> Column:
    """Worst static score; chains and alignment count a little less."""
    return F.least(F.lit(1.0), F.greatest(pattern, behaviour, chain * 0.9, alignment * 0.85))


def declared_classes(steps: DataFrame) -> DataFrame:
    """Capability classes the step texts speak of, as flags per package."""
    low = F.lower("description")
    return steps.groupBy(KEY).agg(
        *[F.bool_or(c.has_any(low, words)).alias("d_" + name) for name, words in fixed.DECLARED_CLASS_WORDS.items()],
        F.bool_or(F.col("target_script") != "").alias("has_link"))


def observed_classes(script_io: DataFrame, flags: DataFrame) -> DataFrame:
    """Capability classes the scripts show, as flags per package."""
    kind, sub = F.col("kind"), F.col("subtype")
    io = script_io.groupBy(KEY).agg(
        F.bool_or((kind == "effect") & (sub == "network_request")).alias("o_network"), F.bool_or(kind == "sensitive_read").alias("o_credential"),
        F.bool_or((kind == "effect") & (sub == "subprocess")).alias("o_subprocess"), F.bool_or((kind == "effect") & (sub == "file_write")).alias("o_file_write"),
        F.bool_or(kind == "input").alias("o_file_read"))
    fl = flags.groupBy(KEY).agg(F.bool_or("has_dynamic_execution").alias("o_dynamic_exec"), F.bool_or("has_obfuscation").alias("o_obfuscation"))
    out = fl.join(io, KEY, "left")
    return out.select(KEY, *[F.coalesce("o_" + n, F.lit(False)).alias("o_" + n) for n in fixed.CAPABILITY_CLASSES])


def set_gap(observed: Column, declared: Column) -> Column:
    """0.6 of the undeclared share plus 0.4 of what the two sets do not have in common."""
    n_c = F.size(observed)
    over = F.size(F.array_except(observed, declared)) / F.greatest(n_c, F.lit(1))
    align = F.size(F.array_intersect(observed, declared)) / F.greatest(F.size(F.array_union(observed, declared)), F.lit(1))
    return F.least(F.lit(1.0), 0.6 * over + 0.4 * (F.lit(1.0) - align))


def class_gap(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """Gap between observed and declared classes; zero where steps could not be understood."""
    j = observed.join(declared, KEY, "left")
    pick = lambda p, names: F.array_compact(F.array(*[F.when(F.col(p + n), F.lit(n)) for n in names]))
    obs = pick("o_", fixed.CAPABILITY_CLASSES)
    dec = pick("d_", list(fixed.DECLARED_CLASS_WORDS))
    unclear = (F.size(dec) == 0) & ~F.coalesce("has_link", F.lit(False))
    return j.select(KEY, obs.alias("observed"), dec.alias("declared"), F.when((F.size(obs) == 0) | unclear, 0.0).otherwise(set_gap(obs, dec)).alias("class_gap"))


def step_threat(packages: DataFrame, phantoms: DataFrame, found: DataFrame, injection: DataFrame) -> DataFrame:
    """Instruction-side score: unreferenced scripts, injected instructions, detector confidence."""
    ph = phantoms.groupBy(KEY).agg(F.count("*").alias("n_phantoms"))
    inj = found.filter("category = 'PromptInjection' and contains(path, 'SKILL.md')").select(KEY).distinct().withColumn("hit", F.lit(True))
    conf = injection.filter("is_injection").select(KEY, F.col("confidence").alias("conf"))
    j = packages.join(ph, KEY, "left").join(inj, KEY, "left").join(conf, KEY, "left")
    n = F.coalesce("n_phantoms", F.lit(0))
    score = F.least(F.lit(0.5), n * 0.2) + F.when(F.col("hit"), 0.5).otherwise(0.0) + F.coalesce(F.least(F.lit(0.5), F.col("conf") * 0.8), F.lit(0.0))
    return j.select(KEY, n.alias("n_phantoms"), F.least(F.lit(1.0), score).alias("step_threat"))


def op_scores(ops: DataFrame) -> DataFrame:
    """Score and description of every operation row."""
    at = F.concat(F.lit(" at "), "path", F.lit(":"), F.col("line").cast("string"))
    t, label = F.col("op_type"), F.col("label")
    entry = lambda v, *text: F.struct(F.lit(v).alias("score"), (F.concat(*text) if text else F.lit("")).alias("description"))
    s = F.lit
    v = fixed.OP_SCORE
    runs = label.contains("eval") | label.contains("exec")
    sys = (
        F.when(runs & F.col("cmd_dynamic"), entry(v["eval_dynamic"], s("eval/exec with dynamic source"), at))
        .when(F.col("cmd_dynamic"), entry(v["process_dynamic"], s("Subprocess with variable command"), at))
        .when(F.col("entropy") > fixed.DENSE_BITS, entry(v["dense"], s("High-entropy string (encoded payload?) near "), "path", s(":"), F.col("line").cast("string")))
        .when(c.is_encoding_b(label), entry(v["encoding"], s("Obfuscation API usage"), at))
        .when(F.col("cmd") != "", entry(v["process"], s("Subprocess call: "), F.substring("cmd", 1, 50), at)).otherwise(entry(0.0)))
    net = F.when(F.col("is_external"), entry(v["net_external"], s("External HTTP call to "), F.substring("url", 1, 60), at)).otherwise(entry(v["net_other"]))
    io = (F.when(F.col("is_sensitive"), entry(v["io_sensitive"], s("Sensitive path access: "), "file_path", at))
          .when(F.col("is_write"), entry(v["io_write"], s("File write: "), F.substring("file_path", 1, 50), at)).otherwise(entry(0.0)))
    env = entry(v["env"], s("Env var access: "), "var_name", at)
    z = F.when(t == "sys_op", sys).when(t == "net_op", net).when(t == "io_op", io).when(t == "env_op", env).otherwise(entry(0.0))
    return ops.withColumn("z", z).select("*", F.col("z.score").alias("score"), F.col("z.description").alias("description")).drop("z")


def top_op_findings(scored: DataFrame, n: int | None = None) -> DataFrame:
    """Strongest operations of each package: score 0.5 and above; with ``n`` only so many."""
    return first_rows(scored.filter("score >= 0.5 and description <> ''"), [KEY], [F.desc("score"), F.col("path"), F.col("line"), F.col("pos"), F.col("op_type"), F.col("label")], n)


def hiding_score(ops: DataFrame, key: str = KEY, scored: Column | None = None) -> DataFrame:
    """Obfuscation score: encoding calls, high-entropy constants, dynamic commands.

    Encoding calls count wherever they are; the rest only in ``scored`` rows.
    """
    here = F.lit(True) if scored is None else scored
    dense = F.count_if(here & (F.col("entropy") > fixed.DENSE_BITS))
    dyn = F.count_if(here & (F.col("op_type") == "sys_op") & F.col("cmd_dynamic"))
    score = F.when(F.bool_or(c.is_encoding_b(F.col("label"))), 0.40).otherwise(0.0) + F.least(F.lit(0.30), dense * 0.10) + F.least(F.lit(0.30), dyn * 0.15)
    return ops.groupBy(key).agg(F.least(F.lit(1.0), score).alias("hiding_score"))


def code_score_b(pattern: Column, taint: Column, hiding: Column, analyzability: Column) -> Column:
    w = fixed.CODE_WEIGHTS_B
    return F.least(F.lit(1.0), w["pattern"] * pattern + w["taint"] * taint + w["hiding"] * hiding + w["opaque"] * (F.lit(1.0) - analyzability))


UNIT_CATEGORIES = {"I-MIS": "i_mis", "I-EXP": "i_exp", "I-EXF": "i_exf", "I-CAM": "i_cam", "I-PRIV": "i_priv"}


def unit_rollup(units: DataFrame, chains: DataFrame) -> DataFrame:
    """Worst score per instruction category, and overall with a bonus for a described chain."""
    per = units.groupBy(KEY).agg(*[F.max(x).alias(x) for x in UNIT_CATEGORIES.values()])
    j = per.join(chains.groupBy(KEY).agg(F.bool_or("kill_chain").alias("kill_chain"), F.max("kill_chain_text").alias("kill_chain_text")), KEY, "full")
    base = F.coalesce(F.greatest(*UNIT_CATEGORIES.values()), F.lit(0.0))
    told = F.coalesce("kill_chain", F.lit(False))
    return j.withColumn("kill_chain", told).withColumn("unit_score", F.least(F.lit(1.0), base + F.when(told, 0.15).otherwise(0.0)))


def flagged_units(units: DataFrame, texts: DataFrame) -> DataFrame:
    """Units whose strongest category passes one half, with their text."""
    best = F.lit("I-MIS")
    top = F.col("i_mis")
    for name, col in list(UNIT_CATEGORIES.items())[1:]:
        best = F.when(F.col(col) > top, name).otherwise(best)
        top = F.greatest(top, F.col(col))
    rows = units.withColumns({"category": best, "score": top}).filter("score > 0.5")
    return rows.join(texts.select(KEY, "step_index", "text"), [KEY, "step_index"], "left").select(
        KEY, "step_index", F.substring(F.coalesce("text", F.lit("")), 1, 80).alias("text"), "category", "score", F.substring("reasoning", 1, 100).alias("reasoning"))


def judge_consensus(verdicts: DataFrame, key: str = KEY) -> DataFrame:
    """Confidence-weighted mean of the judges' scores; plain mean when nobody is confident."""
    w = F.sum("confidence")
    return verdicts.groupBy(key).agg(F.when(w == 0, F.avg("risk_score")).otherwise(F.sum(F.col("risk_score") * F.col("confidence")) / w).alias("judge_score"))


def apply_finding_verdicts(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Reviewer verdicts on HIGH and CRITICAL findings, matched by finding index."""
    v = verdicts.select(KEY, "finding_index", F.col("is_genuine").alias("g"), F.substring("reasoning", 1, 120).alias("review"))
    high = F.col("severity").isin("HIGH", "CRITICAL")
    return df.join(v, [KEY, "finding_index"], "left").withColumns({
        "verified": F.when(high, F.col("g")), "review": F.when(high & F.col("g").isNotNull(), F.col("review")).otherwise("")}).drop("g")
