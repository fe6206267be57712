"""Audit B: a graph of instructions and code, static scores, a gate, and outside scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.functions.tables import cut, empty, fill, findings, numbered, prepare, union_all, written
from packaudit.operators import checks, graph as g
from packaudit.operators import injection as inj
from packaudit.operators import manifest as man
from packaudit.operators import python_code as py
from packaudit.operators import scores
from packaudit.plans import verdicts as ver
from packaudit.sources import packages as src
from packaudit.sources.external import EXTERNAL

KEY = "skill_id"
PHASE1 = ["phase1", "static_findings", "top_ops", "nodes", "edges", "context", "probes", "gaps", "chains", "code_capabilities", "declared_scopes"]


def phase1(files: DataFrame, units: DataFrame | None = None, flows: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything that needs no outside score.  Packages with injected instructions stop early."""
    spark = files.sparkSession
    prepare(spark)
    units = empty(spark, EXTERNAL["instruction_units"]) if units is None else units
    files = src.staged(files)
    packages = written(src.list_packages(src.of_kind(files, "doc"), require_manifest=True), "packages")
    listed = files.join(packages, KEY, "left_semi")
    injected = inj.weighted_confidence(inj.weighted_hits(src.injection_sources(src.of_kind(listed, "doc", "py")).select(KEY, "path", "content")))
    stopped = written(injected.filter("detected").select(KEY), "stopped")
    live = listed.join(stopped, KEY, "left_anti")
    units = units.join(packages, KEY, "left_semi")

    parsed = written(py.parse(src.text_files(src.of_kind(live, "py"))), "parsed")
    ops = py.code_ops(py.tokens(parsed), src.non_python_sources(src.of_kind(live, "doc", "yaml")))
    ops = written(g.with_code_ids(ops), "ops")
    perms = written(man.permissions(src.manifest_file(src.of_kind(live, "doc"))), "permissions")
    fields = written(man.manifest_fields(src.manifest_file(src.of_kind(live, "doc"))), "manifest")
    scopes = written(g.declared_scopes(units), "scopes")
    judged = g.best_step(g.declared_ops(ops, scopes), g.step_anchors(units))
    judged = written(judged.select(KEY, "id", "path", "line", "op_type", "label", "risk", "declared", "anchor"), "judged")
    live_units = units.join(stopped, KEY, "left_anti")
    cross = g.cross_edges(judged)
    misaligned = cross.filter("edge_type = 'misalign'")
    node_rows = g.nodes(live_units, ops, perms)
    edge_rows = written(union_all([g.sibling_edges(live_units), g.ctrl_flow_edges(ops), cross, g.covers_edges(ops, perms)]), "edges")
    sibling = edge_rows.filter("edge_type = 'nl_flow'")

    scored = scores.op_scores(ops.filter(py.scored_paths()))
    tainted = g.propagate_taint(ops, flows) if flows is not None else ops.select(KEY, "id").limit(0)
    risky = ops.filter("op_type = 'sys_op'").join(tainted, [KEY, "id"], "left_semi")
    risk = risky.groupBy(KEY).agg(F.max("risk").alias("taint_risk"))
    strong = scores.top_op_findings(scored).select(KEY, "score", "description", "path", "line", "pos", "op_type", "label")
    reached = risky.select(KEY, F.col("risk").alias("score"), F.concat(F.lit("Tainted data flows to "), "label", F.lit(" at "), "path", F.lit(":"), F.col("line").cast("string")).alias("description"),
                           "path", "line", "pos", "op_type", "label")
    top = written(strong.unionByName(reached), "top_ops")

    sequences = [g.op_chains(ops), g.step_escalation(live_units, sibling, misaligned), *([] if flows is None else [g.flow_chains(ops, flows)])]
    chains = written(g.dedupe_chains(union_all(sequences)), "chains")
    caps = written(g.code_capabilities(ops), "caps")
    readable = py.analyzability(parsed).groupBy(KEY).agg(F.min("analyzability").alias("analyzability"))
    alive = packages.join(stopped, KEY, "left_anti")
    gaps = written(g.top_gaps(g.over_reach_rows(caps, g.declared_of(alive, scopes))), "gaps")
    gap = written(g.alignment(alive, caps, scopes, misaligned, readable, gaps), "alignment")
    checked = written(checks.run_checks({"files": live, "manifest": fields, "permissions": perms, "ops": ops, "edges": edge_rows}), "checked")

    parts = [
        scored.groupBy(KEY).agg(F.max("score").alias("pattern_score")), risk, scores.hiding_score(ops, scored=py.scored_paths()), gap,
        scores.chain_score_b(chains).withColumnRenamed("chain_score", "s_chain"), scores.check_score(checked).withColumnRenamed("check_score", "s_check"),
    ]
    j = packages
    for part in parts:
        j = j.join(part, KEY, "left")
    j = j.join(stopped.withColumn("injection", F.lit(True)), KEY, "left")
    j = fill(j, {**{x: 0.0 for x in ("pattern_score", "taint_risk", "hiding_score", "alignment_gap", "over_reach", "align_score", "s_chain", "s_check")},
                 "misalign_count": 0, "injection": False, "analyzability": 1.0})
    s2 = F.when(F.col("injection"), 0.0).otherwise(scores.code_score_b(F.col("pattern_score"), F.col("taint_risk"), F.col("hiding_score"), F.col("analyzability")))
    j = j.withColumns({"s2": s2, "s3": F.when(F.col("injection"), 0.0).otherwise(F.col("alignment_gap"))})
    j = j.withColumn("static_overall", scores.static_overall(*[F.col(x) for x in ("pattern_score", "taint_risk", "s_chain", "s3")]))
    first = written(ver.fast_gate(j), "phase1")
    needs = first.filter("needs_judges").select(KEY)
    static = static_findings(top, chains, gaps, checked)
    return {
        "phase1": first, "static_findings": static, "top_ops": top, "nodes": node_rows, "edges": edge_rows, "chains": chains, "gaps": gaps,
        "context": g.context_lines(scopes, caps, judged, first), "probes": inj.probe_hits(src.text_files(live).join(needs, KEY, "left_semi")),
        "code_capabilities": caps, "declared_scopes": scopes,
    }


def static_findings(top: DataFrame, chains: DataFrame, gaps: DataFrame, checked: DataFrame) -> DataFrame:
    """Findings of all static stages with the index that outside reviews refer to."""
    sev = F.when(F.col("score") > 0.85, "CRITICAL").when(F.col("score") > 0.60, "HIGH").otherwise("MEDIUM")
    a = findings(top, "pattern/behavioral", sev, "Unknown", F.col("description"), path=F.col("path"), line=F.col("line"), pos=F.col("pos"), evidence=F.lpad(F.format_number(1 - F.col("score"), 4), 8, "0"))
    b = findings(chains, "chain", F.col("severity"), F.col("category"), F.col("description"), path=F.col("path"), line=F.col("line"))
    d = findings(gaps, "cmia", "MEDIUM", "T11-CapabilityExpansion", F.concat(F.lit("Code capability not declared in SKILL.md: "), "gap"), pos=F.monotonically_increasing_id() * 0)
    rows = union_all([a.withColumn("stage", F.lit(1)), b.withColumn("stage", F.lit(2)), d.withColumn("stage", F.lit(3)), checked.withColumn("stage", F.lit(4))])
    order = [F.col("evidence"), F.col("line"), F.col("pos"), F.col("analyzer"), F.col("description")]
    rows = rows.withColumn("place", F.when(F.col("stage") == 1, "").otherwise(F.col("path")))
    return numbered(written(rows, "static_rows"), KEY, ["stage", "place"], order, "finding_index").drop("stage", "place")


def phase2(first: dict[str, DataFrame], unit_scores: DataFrame | None = None, unit_chains: DataFrame | None = None, units: DataFrame | None = None,
           finding_verdicts: DataFrame | None = None, judge_verdicts: DataFrame | None = None, thresholds: dict | None = None) -> dict[str, DataFrame]:
    """Join the outside scores of the packages the gate lets through, fuse and decide."""
    spark = first["phase1"].sparkSession
    get = lambda df, name: empty(spark, EXTERNAL[name]) if df is None else df
    p1 = first["phase1"]
    needs = p1.filter("needs_judges").select(KEY)
    only = lambda df: df.join(needs, KEY, "left_semi")
    us = only(get(unit_scores, "unit_scores"))
    uc = only(get(unit_chains, "unit_chains"))
    jv = only(get(judge_verdicts, "judge_verdicts"))
    fv = only(get(finding_verdicts, "finding_verdicts"))
    reviewed = scores.apply_finding_verdicts(first["static_findings"], fv)
    rolled = scores.unit_rollup(us, uc)
    flagged = scores.flagged_units(us, get(units, "instruction_units"))
    j = (p1.join(rolled.select(KEY, F.col("unit_score").alias("s1")), KEY, "left").join(scores.judge_consensus(jv).withColumnRenamed("judge_score", "s4"), KEY, "left")
         .join(scores.filtered_score(reviewed), KEY, "left").join(scores.severity_summary(first["static_findings"]).select(KEY, "n_findings"), KEY, "left")
         .join(first["probes"].withColumn("probe", F.lit(True)), KEY, "left"))
    j = fill(j, {"s1": 0.0, "filtered_score": 0.0, "n_findings": 0, "probe": False})
    j = j.withColumn("injection", F.col("injection") | F.col("probe"))
    reports = ver.decide_b(ver.fuse_b(j), thresholds or ver.fixed.THRESHOLDS_B).drop("probe")
    reports = written(reports, "reports")
    chains = ver.kill_chains(reports, first["top_ops"], flagged, rolled, jv)
    return {"reports": reports, "findings": reviewed, "flagged_units": flagged, "kill_chains": chains["chains"], "kill_chain_evidence": chains["evidence"]}


def audit(files: DataFrame, units: DataFrame | None = None, flows: DataFrame | None = None, **outside) -> dict[str, DataFrame]:
    """Both phases in one go."""
    first = phase1(files, units, flows)
    return {**first, **phase2(first, units=units, **outside)}
