"""Audit A: what a package's instructions declare against what its scripts do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.functions import columns as c
from packaudit.functions.tables import fill, prepare, union_all, written
from packaudit.operators import chains as chain_ops
from packaudit.operators import contracts as con
from packaudit.operators import injection as inj
from packaudit.operators import manifest as man
from packaudit.operators import other_code as oth
from packaudit.operators import python_code as py
from packaudit.operators import reputation as rep
from packaudit.operators import rules, scores, steps as stp, taint
from packaudit.plans import verdicts as ver
from packaudit.sources import packages as src

KEY = "skill_id"


def read_code(files: DataFrame) -> dict[str, DataFrame]:
    """Facts and findings of all code and text files."""
    text = src.text_files(files)
    parsed = written(py.parse(src.of_kind(text, "py")), "parsed")
    toks = py.tokens(parsed)
    called, literals = written(py.calls(toks), "calls"), written(py.string_literals(toks), "literals")
    divisions, imported = py.path_divisions(parsed), py.imports(parsed)
    ops = union_all([py.call_findings(called), py.division_findings(divisions), py.reverse_shells(called), rules.literal_findings(literals)])
    hits = written(rules.line_findings(text), "line_hits")
    py_hits = rules.drop_duplicate_hits(hits.filter("path like '%.py'"), ops)
    other = src.of_kind(text, "shell", "js", "yaml")
    found = union_all([ops, py_hits, hits.filter("path not like '%.py'"), oth.other_findings(other), src.binary_findings(src.of_kind(files, "binary"))])
    io = union_all([py.python_io(called, literals, divisions, imported, parsed), oth.shell_io(src.of_kind(text, "shell")), oth.js_io(src.of_kind(text, "js"))])
    flags = py.python_flags(parsed, called, literals, imported).unionByName(oth.other_flags(other))
    return {
        "findings": scores.dedupe_findings(found),
        "script_io": written(io, "script_io"),
        "script_flags": written(flags, "script_flags"),
        "scripts": text.filter(oth.is_script()).select(KEY, "path"),
    }


def read_instructions(files: DataFrame, supplied_steps: DataFrame | None = None) -> dict[str, DataFrame]:
    """Manifest, permissions and steps; supplied steps win over extracted ones per package."""
    manifests = src.manifest_file(src.of_kind(files, "doc"))
    fields = written(man.manifest_fields(manifests), "manifest")
    found = stp.extract_steps(fields)
    if supplied_steps is not None:
        have = supplied_steps.select(KEY).distinct()
        found = stp.in_run_order(supplied_steps.select(*found.columns)).unionByName(found.join(have, KEY, "left_anti"))
    return {"manifests": manifests, "manifest": fields, "permissions": written(man.permissions(manifests), "permissions"), "steps": written(found, "steps")}


def audit(files: DataFrame, supplied_steps: DataFrame | None = None, supplied_contracts: DataFrame | None = None,
          reputation: DataFrame | None = None, strict_labels: bool = False, thresholds: dict | None = None) -> dict[str, DataFrame]:
    """All result tables of audit A, keyed by name; ``reports`` has one row per package."""
    prepare(files.sparkSession)
    files = src.staged(files)
    code = read_code(files)
    text = read_instructions(files, supplied_steps)
    fields, perms, steps = text["manifest"], text["permissions"], text["steps"]
    io, flags, scripts = code["script_io"], code["script_flags"], code["scripts"]
    packages = src.list_packages(files)

    hits = written(inj.detect_tiered(src.injection_files(src.of_kind(files, "doc", "yaml"))), "injection_hits")
    injected = inj.tiered_confidence(hits)
    found = union_all([
        inj.injection_finding(hits), code["findings"],
        man.validate_manifest(text["manifests"], fields, perms, files), src.missing_manifest_findings(files)])

    contracts = con.infer_contracts(steps, fields, perms)
    if supplied_contracts is not None:
        contracts = con.prefer_supplied(contracts, supplied_contracts)
    contracts = written(contracts, "contracts")
    violations = written(con.verify_contracts(steps, contracts, io, flags), "violations")
    flows = written(taint.taint_chains(steps, fields, io, flags, strict_labels), "taint_chains")
    summary = stp.program_summary(steps)
    enriched = con.enrich_findings(found, steps, summary, contracts)
    urls = rep.external_urls(io)
    if reputation is not None:
        late = rep.reputation_findings(rep.urls_to_check(urls), reputation)
        enriched = enriched.unionByName(late, allowMissingColumns=True)
    enriched = written(enriched, "findings")
    attacks = written(chain_ops.attack_chains(io, flags, steps), "attack_chains")
    phantoms = con.phantom_scripts(scripts, summary, steps)
    proof = written(ver.evidence(violations, flows, enriched, phantoms, attacks), "evidence")

    parts = [
        scores.code_threat(enriched), scores.contract_score(violations), scores.taint_score(flows), scores.chain_score_a(attacks),
        scores.step_threat(packages, phantoms, enriched, injected), scores.class_gap(scores.observed_classes(io, flags), scores.declared_classes(steps)),
        ver.evidence_counts(proof), package_summary(fields, steps, scripts, io, flags),
    ]
    j = packages
    for part in parts:
        j = j.join(part, KEY, "left")
    j = fill(j, {
        **{x: 0.0 for x in ("code_threat", "contract_score", "taint_score", "chain_score", "step_threat", "class_gap")},
        **{x: 0 for x in ("n_findings", "n_violations", "n_taint", "n_phantoms", "n_evidence", "n_critical")},
        **{x: False for x in ("critical_contract", "undeclared_exfil", "complete_chain")}})
    reports = ver.decide_a(ver.fuse_a(j), thresholds or ver.fixed.THRESHOLDS_A)
    return {
        "reports": reports, "evidence": proof, "findings": enriched, "enrichment_log": con.enrichment_log(enriched), "violations": violations,
        "contracts": contracts, "taint_chains": flows, "attack_chains": attacks, "chain_evidence": chain_ops.chain_evidence(attacks, io), "phantoms": phantoms, "external_urls": urls, "observed_places": observed_places(io), "injection": injected,
        "steps": steps, "manifest": fields, "permissions": perms, "script_io": io, "script_flags": flags,
    }


def observed_places(io: DataFrame) -> DataFrame:
    """Distinct sensitive reads and network destinations of each package, one row each."""
    place = F.when(F.col("kind") == "sensitive_read", "reads").when((F.col("kind") == "effect") & (F.col("subtype") == "network_request"), "nets")
    return io.select(KEY, place.alias("place"), "detail").filter("place is not null").distinct()


def package_summary(fields: DataFrame, steps: DataFrame, scripts: DataFrame, io: DataFrame, flags: DataFrame) -> DataFrame:
    """Purpose, step and script counts, number of distinct sensitive reads and destinations, flags."""
    st = steps.groupBy(KEY).agg(F.count("*").alias("step_count"), F.count_if(F.col("target_script") != "").alias("linked_steps"))
    sc = scripts.groupBy(KEY).agg(F.count("*").alias("scripts_found"))
    d = observed_places(io).groupBy(KEY).agg(F.count_if(F.col("place") == "reads").alias("sensitive_reads"), F.count_if(F.col("place") == "nets").alias("network_destinations"))
    out = fields.select(KEY, F.col("name").alias("skill_name"), "purpose")
    for part in (st, sc, d, scores.package_flags(flags).drop("n_files", "min_analyzability")):
        out = out.join(part, KEY, "full")
    return out
