"""Evidence, score fusion and verdicts of both analyzers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit.functions import columns as c
from packaudit.functions import fixed
from packaudit.functions.tables import first_rows, union_all, written

KEY = "skill_id"


def evidence(violations: DataFrame, chains: DataFrame, found: DataFrame, phantoms: DataFrame, attacks: DataFrame) -> DataFrame:
    """All signals in one shape, ranked by severity; one row per item."""
    none = c.empty_strings()

    def shape(df, kind, seq, severity, title, description, step=None, script=None, taint_path=None, why=None):
        return df.select(
            KEY, F.lit(kind).alias("evidence_type"), F.lit(seq).alias("seq"), severity.alias("severity"), title.alias("title"), description.alias("description"),
            (F.lit("") if step is None else step).alias("step"), (F.lit("") if script is None else script).alias("script"),
            (none if taint_path is None else taint_path).alias("taint_path"), (F.lit("") if why is None else why).alias("justification"))

    s = F.col
    v = shape(violations, "contract_violation", 0, s("severity"), F.concat(F.lit("Contract Violation: "), "violation_type"), s("violation"), s("step_id"), s("script"),
              why=F.concat(F.lit("Expected: "), "expected", F.lit(". Actual: "), "actual"))
    flow = F.concat(F.lit("Sensitive data ("), "label", F.lit(": "), "detail", F.lit(") originates in "), "origin_script", F.lit(" (step "), "origin_step",
                    F.lit("), reaches "), "sink_type", F.lit(" sink "), "sink_detail", F.lit(" in "), "dest_script", F.lit(" (step "), "dest_step", F.lit(")"))
    t = shape(chains, "taint_chain", 1, s("severity"), F.concat(F.lit("Cross-Script Data Flow: "), "label"), flow, s("origin_step"), s("dest_script"),
              F.concat(F.array("detail"), "scripts", F.array("sink_detail")),
              F.when(s("declared"), "This flow is declared in NL.").otherwise("This flow is NOT declared in NL."))
    hi = found.filter("severity in ('CRITICAL', 'HIGH')")
    f = shape(hi, "code_finding", 2, s("severity"), F.concat(F.lit("Code Threat: "), "category"), s("description"), script=s("path"),
              why=F.coalesce("enrichment_reason", F.concat(F.lit("Static analysis detection (confidence="), s("confidence").cast("string"), F.lit(")"))))
    p = shape(phantoms, "phantom_script", 3, F.lit("MEDIUM"), F.concat(F.lit("Phantom Script: "), "path"),
              F.concat(F.lit("Script '"), "path", F.lit("' exists in skill directory but is not referenced in SKILL.md")), script=s("path"),
              why=F.lit("Unreferenced scripts may contain hidden functionality not visible to the user via SKILL.md"))
    a = shape(attacks, "pipeline_attack", 4, s("severity"), F.concat(F.lit("Kill Chain: "), "chain_type"), s("description"), script=s("script"),
              why=F.concat(F.lit("Multi-stage attack chain detected: "), F.array_join("stages", ", ")))
    return union_all([v, t, f, p, a]).withColumn("rank", c.severity_rank(F.col("severity")))


def evidence_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(KEY).agg(F.count("*").alias("n_evidence"), F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"))


def fuse_a(df: DataFrame) -> DataFrame:
    """Probability as the worst of six pathways; columns in [0, 1]: code_threat, contract_score,
    class_gap, chain_score, step_threat, taint_score."""
    s = F.col
    align = F.greatest("contract_score", "class_gap")
    w, bias = fixed.COMBINED_A, fixed.FUSION_A
    signals = {"code": s("code_threat"), "align": align, "chain": s("chain_score"), "step": s("step_threat"), "taint": s("taint_score")}
    raw = w["align_x_code"] * align * s("code_threat")
    for name, value in signals.items():
        raw = raw + w[name] * value
    return df.withColumn("overall", F.greatest(*[c.logistic(x, bias["k"], bias[n]) for n, x in {**signals, "combined": raw}.items()]))


def decide_a(df: DataFrame, thresholds: dict[str, float] = fixed.THRESHOLDS_A) -> DataFrame:
    """Floors that certain evidence sets, then the threshold ladder and a confidence.

    Needs overall, undeclared_exfil, critical_contract, complete_chain, n_critical, n_evidence.
    """
    t = thresholds
    lift = fixed.LIFT_A
    floor = lambda test: F.when(F.col(test), t["review"] + lift[test]).otherwise(0.0)
    score = F.greatest("overall", floor("undeclared_exfil"), floor("critical_contract"), floor("complete_chain"),
                       F.when(F.col("n_critical") >= 2, t["block"] + lift["two_critical"]).otherwise(0.0))
    out = df.withColumn("decided", score)
    d = F.col("decided")
    conf = (F.when((F.col("n_critical") > 0) & (d > t["review"]), F.least(F.lit(0.95), d + 0.1))
            .when((d < 0.2) & (F.col("n_evidence") == 0), 0.9).otherwise(F.greatest(F.lit(0.5), d)))
    return out.withColumns({"verdict": ladder(d, t, strict=False), "confidence": conf})


def ladder(p: Column, t: dict[str, float], strict: bool) -> Column:
    over = (lambda v: p > v) if strict else (lambda v: p >= v)
    return F.when(over(t["block"]), "BLOCK").when(over(t["review"]), "REVIEW").when(over(t["warn"]), "WARN").otherwise("PASS")


def fuse_b(df: DataFrame) -> DataFrame:
    """Probability as the worst of six pathways; s2, s3, s_chain, s_check and the optional
    outside scores s1 (default 0) and s4 (null when no judge was asked)."""
    s = F.col
    norm = F.coalesce(F.greatest((s("s4") - 0.5) * 2.0, F.lit(0.0)), F.lit(0.0))
    s1 = F.coalesce("s1", F.lit(0.0))
    n = (s1 > 0).cast("int") + (norm > 0).cast("int")
    nl = F.when(n > 0, (F.greatest(s1, F.lit(0.0)) + norm) / n).otherwise(0.0)
    w, bias = fixed.COMBINED_B, fixed.FUSION_B
    raw = (w["align"] * s("s3") + w["code"] * s("s2") + w["chain"] * s("s_chain") + w["align_x_code"] * s("s2") * s("s3")
           + w["nl"] * s1 + w["judge"] * norm)
    ways = {"code": s("s2"), "align": s("s3"), "chain": s("s_chain"), "check": s("s_check"), "nl": nl, "combined": raw}
    return df.withColumn("p", F.greatest(*[c.logistic(x, bias["k"], bias[n]) for n, x in ways.items()]))


def decide_b(df: DataFrame, thresholds: dict[str, float] = fixed.THRESHOLDS_B) -> DataFrame:
    """Verdict, severity and confidence; a detected injection lifts the probability to a floor."""
    p = F.when(F.coalesce("injection", F.lit(False)), F.greatest("p", F.lit(fixed.INJECTION_FLOOR))).otherwise(F.col("p"))
    out = df.withColumn("p", p)
    t = thresholds
    sev = F.when(F.col("p") > t["block"], "CRITICAL").when(F.col("p") > t["review"], "HIGH").when(F.col("p") > t["warn"], "MEDIUM").otherwise("LOW")
    return out.withColumns({"verdict": ladder(F.col("p"), t, strict=True), "severity": sev,
                            "confidence": F.greatest(F.abs(F.col("p") - 0.5) * 2, F.lit(0.1))})


def fast_gate(df: DataFrame) -> DataFrame:
    """Quick probability from the static scores, and whether outside scoring is worth its cost."""
    raw = F.lit(0.0)
    for name, weight in fixed.GATE_WEIGHTS.items():
        raw = raw + weight * F.col(name)
    inj = F.coalesce("injection", F.lit(False))
    out = df.withColumn("fast_p", F.when(inj, 1.0).otherwise(c.logistic(raw, *fixed.GATE_CURVE)))
    skip = inj | (F.col("fast_p") < fixed.GATE_LOW) | (F.col("fast_p") > fixed.GATE_HIGH)
    return out.withColumn("needs_judges", ~skip)


_CHAIN_WORDS = {"net": ["external", "http"], "cred": ["sensitive", "ssh", "credential", "aws"],
                "obf": ["obfuscat", "base64", "eval", "exec", "entropy", "encoded"]}
# chain -> the kind of operations and the kind of flagged steps that are its evidence
_CHAIN_EVIDENCE = {"directed": ("net", "exf"), "theft": ("cred", "any"), "hidden": ("obf", None)}


def _chain_operations(top_ops: DataFrame) -> DataFrame:
    low = F.lower("description")
    kinds = F.array_compact(F.array(*[F.when(c.has_any(low, w), F.lit(k)) for k, w in _CHAIN_WORDS.items()]))
    return top_ops.select(KEY, F.explode(kinds).alias("kind"), "score", "path", "line", "pos", F.substring("description", 1, 80).alias("text"))


def _chain_steps(flagged: DataFrame) -> DataFrame:
    at = lambda more: F.concat(F.lit("Step "), F.col("step_index").cast("string"), more, F.substring("text", 1, 60))
    row = lambda k, t: F.struct(F.lit(k).alias("kind"), t.alias("text"))
    told = F.when(F.col("category").isin("I-EXF", "I-EXP"), row("exf", at(F.concat(F.lit(" ("), "category", F.lit("): ")))))
    return flagged.select(KEY, "step_index", F.inline(F.array_compact(F.array(told, row("any", at(F.lit(": ")))))))


def kill_chains(scores: DataFrame, top_ops: DataFrame, flagged: DataFrame, units: DataFrame, verdicts: DataFrame) -> dict[str, DataFrame]:
    """Chains told by several modules at once: ``chains``, and their ``evidence`` as a child table.

    A chain carries how many operations (``n_code``) and steps (``n_nl``) tell of it; the rows
    of the evidence name them with what they are ordered by: score, place, step.  All evidence
    is kept, and per package there are only counts and maxima, so a package may have any number
    of operations; ``first_rows`` gives the few a report shows.
    """
    ops, steps = _chain_operations(top_ops), _chain_steps(flagged)
    n_ops = ops.groupBy(KEY).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in _CHAIN_WORDS], F.max(F.when(F.col("kind") == "cred", F.col("score"))).alias("top_cred"))
    n_steps = steps.groupBy(KEY).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("exf", "any")])
    j = scores.join(n_ops, KEY, "left").join(n_steps, KEY, "left").join(units.select(KEY, "kill_chain", "kill_chain_text", "unit_score"), KEY, "left")
    j = j.withColumns({k: F.coalesce(k, F.lit(0)) for k in (*_CHAIN_WORDS, "exf", "any")})
    s, none = F.col, F.lit(0)

    def chain(key, test, severity, n_code, n_nl, miss, part):
        name, strategy = fixed.KILL_CHAINS[key]
        return F.when(test, F.struct(
            F.lit(key).alias("key"), F.lit(name).alias("name"), severity.alias("severity"), n_code.cast("long").alias("n_code"), n_nl.cast("long").alias("n_nl"),
            miss.cast("long").alias("misalign_count"), part.cast("double").alias("contribution"), F.lit(strategy).alias("strategy")))

    told = F.coalesce("kill_chain", F.lit(False)) & (F.coalesce("kill_chain_text", F.lit("")) != "")
    own = F.array_compact(F.array(
        chain("directed", (s("exf") > 0) & (s("net") > 0) & (s("s3") > 0.35), F.when(s("p") > 0.85, "CRITICAL").otherwise("HIGH"), s("net"), s("exf"), s("misalign_count"), s("s3")),
        chain("theft", (s("cred") > 0) & (s("p") > 0.45), F.when(s("top_cred") > 0.80, "CRITICAL").otherwise("HIGH"), s("cred"), s("any"), s("misalign_count"), s("over_reach")),
        chain("hidden", (s("obf") > 0) & (s("hiding_score") > 0.40), F.lit("HIGH"), s("obf"), none, s("misalign_count"), s("hiding_score")),
        chain("told", told, F.lit("HIGH"), none, F.lit(1), none, s("unit_score"))))
    first = written(j.select(KEY, F.when(told, F.substring("kill_chain_text", 1, 200)).alias("told_text"), F.inline(own)), "kill_chains")

    nothing = {"score": F.lit(None).cast("double"), "path": F.lit(None).cast("string"), "line": F.lit(None).cast("int"), "pos": F.lit(None).cast("int"), "step_index": F.lit(None).cast("int")}
    shape = lambda df, side: df.select(KEY, "name", F.lit(side).alias("side"), *[(F.col(k) if k in df.columns else x).cast("double" if k == "score" else "string" if k == "path" else "int").alias(k) for k, x in nothing.items()], "text")
    proof = []
    for key, (code, nl) in _CHAIN_EVIDENCE.items():
        of = first.filter(s("key") == key).select(KEY, "name")
        proof.append(shape(of.join(ops.filter(s("kind") == code), KEY), "code"))
        if nl:
            proof.append(shape(of.join(steps.filter(s("kind") == nl), KEY), "nl"))
    proof.append(shape(first.filter("key = 'told'").select(KEY, "name", s("told_text").alias("text")), "nl"))
    evidence = written(union_all(proof), "kill_chain_evidence")

    # What a judge quotes counts if no chain has it already.
    quoted = verdicts.filter(s("is_malicious") & (F.size("evidence") > 0) & ~F.arrays_overlap("threat_categories", c.str_array(["T1-CredentialTheft", "T3-DataExfiltration"])))
    quoted = written(quoted.join(scores.select(KEY), KEY, "left_semi").withColumn("judge", F.monotonically_increasing_id()), "judged")
    quotes = quoted.select(KEY, "judge", F.posexplode("evidence").alias("pos", "text")).join(evidence.select(KEY, "text").distinct(), [KEY, "text"], "left_anti")
    fresh = quotes.groupBy(KEY, "judge").agg(F.count("*").alias("n_code"))
    label = F.array_join(F.slice("threat_categories", 1, 2), ", ")
    named = quoted.join(fresh, [KEY, "judge"]).withColumn("name", F.concat(F.lit("Judge-Detected: "), F.when(label == "", "Unknown Threat").otherwise(label)))
    more = named.select(KEY, "name", F.when(s("risk_score") > 0.75, "HIGH").otherwise("MEDIUM").alias("severity"), "n_code", none.cast("long").alias("n_nl"), none.cast("long").alias("misalign_count"),
                        s("risk_score").alias("contribution"), F.concat(F.lit("Detected by "), "judge_role", F.lit(" judge")).alias("strategy"))
    evidence = evidence.unionByName(shape(quotes.join(named.select(KEY, "judge", "name"), [KEY, "judge"]), "code"))
    return {"chains": first.drop("told_text", "key").unionByName(more), "evidence": evidence}


def batch_summary(reports: DataFrame) -> DataFrame:
    """Packages per verdict, each counted once."""
    return reports.groupBy("verdict").agg(F.count("*").alias("n_packages"))


def worst_verdict(reports: DataFrame) -> DataFrame:
    rank = F.max(c.ranked(F.col("verdict"), fixed.VERDICTS))
    return reports.agg(F.element_at(c.str_array(fixed.VERDICTS), rank + 1).alias("worst_verdict"), F.count("*").alias("n_packages"))


def label_join(reports: DataFrame, labels: DataFrame) -> DataFrame:
    """Reports with their truth and outcome; a package counts as flagged at REVIEW or BLOCK."""
    j = reports.select(KEY, "verdict").join(labels, KEY)
    flagged = F.col("verdict").isin("BLOCK", "REVIEW")
    outcome = (F.when(F.col("is_malicious"), F.when(flagged, "TP").otherwise("FN")).otherwise(F.when(flagged, "FP").otherwise("TN")))
    return j.withColumns({"flagged": flagged, "outcome": outcome})


def confusion_matrix(judged: DataFrame) -> DataFrame:
    """Counts and rates; a rate without a denominator is zero."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    counts = judged.agg(n("TP").alias("tp"), n("TN").alias("tn"), n("FP").alias("fp"), n("FN").alias("fn"))
    div = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    out = counts.withColumns({"precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "fpr": div(fp, fp + tn), "accuracy": div(tp + tn, tp + tn + fp + fn)})
    pr = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(pr, F.lit(0.0)), F.lit(0.0)))
