"""One query per operator, each a function of (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packaudit.functions import columns as c
from packaudit.functions import fixed
from packaudit.functions.tables import findings, first_rows, numbered, prepare, written
from packaudit.harness import views as v
from packaudit.operators import chains, contracts, graph as g, injection as inj, manifest as man
from packaudit.operators import other_code, python_code as py, reach, reputation as rep, rules, scores, steps as stp, taint
from packaudit.plans import crossmodal, graph_audit, verdicts as ver
from packaudit.sources import packages as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf)

    QUERIES[fn.__name__] = run
    return run


def r6(col) -> Column:
    return F.round(col, 6)


# --------------------------------------------------------------------- files and lines


@query
def line_explode(spark, sf):
    return rules.explode_lines(v.files(spark, sf)).select("skill_id", "path", F.col("line").cast("long").alias("line"), "text")


@query
def rule_scan_lines(spark, sf):
    unscoped = [rules.Rule(r.name, r.pattern, r.severity, r.category, anchors=r.anchors) for r in v.RULES]
    return rules.scan_lines(v.files(spark, sf), unscoped).select("skill_id", "path", F.col("line").cast("long").alias("line"), "rule", "severity")


@query
def rule_scan_scoped(spark, sf):
    return v.hits(spark, sf).select("skill_id", "path", F.col("line").cast("long").alias("line"), "rule", "category")


@query
def builtin_rules_scripts(spark, sf):
    f = rules.line_findings(v.script_files(spark, sf))
    return f.groupBy("skill_id", "severity", "category").agg(F.count("*").alias("n"))


@query
def list_packages(spark, sf):
    return src.list_packages(v.packages(spark, sf), require_manifest=True)


@query
def high_entropy_literals(spark, sf):
    words = v.files(spark, sf).select("skill_id", "path", F.posexplode(c.words(F.col("content"))).alias("pos", "value"))
    dense = rules.high_entropy(words, 3.2, 14)
    return dense.select("skill_id", "path", "value", r6("bits").alias("bits")).distinct()


# ------------------------------------------------------------------------- injection


@query
def weighted_rules_confidence(spark, sf):
    h = inj.weighted_hits(v.files(spark, sf).select("skill_id", "path", "content"), v.WEIGHTED, anchors=v.ANCHORS)
    return inj.weighted_confidence(h).select("skill_id", "distinct_rules", r6("confidence").alias("confidence"), "detected")


@query
def weighted_rules_per_text(spark, sf):
    f = v.files(spark, sf).select(F.col("path").alias("skill_id"), "content")
    return inj.weighted_confidence(inj.weighted_hits(f, v.WEIGHTED, anchors=v.ANCHORS)).select("skill_id", "distinct_rules", r6("confidence").alias("confidence"), "detected")


@query
def tiered_confidence(spark, sf):
    f = v.files(spark, sf).select(F.col("path").alias("skill_id"), "content")
    h = inj.tier_hits(f, v.TIERS, anchors=v.ANCHORS).select("skill_id", "tier", "name").distinct()
    out = inj.tiered_confidence(h)
    return out.select("skill_id", *[F.col(x).cast("long").alias(x) for x in ("tier1", "tier2", "hidden")], r6("confidence").alias("confidence"), "is_injection")


@query
def repeat_flood(spark, sf):
    f = v.files(spark, sf)
    return inj.flood_hits(f, line_length=400, lines_over=60, min_chars=5000, share=0.02).select("skill_id", "name")


@query
def repeat_flood_per_text(spark, sf):
    return inj.flood_hits(v.files(spark, sf), line_length=200, lines_over=20, min_chars=1500, share=0.06, key="path").select("path", "name")


@query
def encoded_runs(spark, sf):
    f = v.files(spark, sf).withColumn("file_order", F.lit(0))
    return inj.base64_runs(f, r"[A-Za-z0-9+/]{40,}").select("skill_id", "path", F.col("pos").cast("long").alias("pos"), "run")


@query
def builtin_injection_texts(spark, sf):
    """The built-in tiers, hidden-text checks and weighted rules over all documents."""
    f = v.files(spark, sf).withColumn("file_order", F.lit(0))
    a = inj.detect_tiered(f).select("skill_id", "tier", "name")
    b = inj.weighted_hits(f.select("skill_id", "path", "content")).select("skill_id", F.lit("weighted").alias("tier"), "name").distinct()
    return a.unionByName(b)


@query
def builtin_tiers_texts(spark, sf):
    """Built-in tier, weighted, encoded-text and invisible-character rules, per document."""
    f = v.dealt(v.phrased_texts(spark, sf).select(F.col("path").alias("skill_id"), "content"), "skill_id", "content")
    a = inj.tier_hits(f, inj.tier_rules()).select("skill_id", "tier", "name")
    b = inj.weighted_hits(f).select("skill_id", F.lit("weighted").alias("tier"), "name")
    return a.unionByName(b).unionByName(inj.invisible_hits(f, 0)).unionByName(inj.encoded_hits(f))


# -------------------------------------------------------------------------- findings


@query
def finding_dedupe(spark, sf):
    twice = v.hit_findings(spark, sf)
    again = twice.withColumns({"analyzer": F.lit("second"), "pos": F.col("pos") + 10})
    d = scores.dedupe_findings(twice.unionByName(again))
    return d.select("skill_id", "analyzer", "category", "path", F.col("line").cast("long").alias("line"), "description", F.col("pos").cast("long").alias("pos"))


@query
def finding_topn(spark, sf):
    h = v.hit_findings(spark, sf).withColumn("rank", c.severity_rank(F.col("severity")))
    top = first_rows(h, ["skill_id"], [F.desc("rank"), F.col("path"), F.col("line"), F.col("pos")], 5)
    return top.select("skill_id", "severity", "path", F.col("line").cast("long").alias("line"), "evidence")


@query
def finding_numbering(spark, sf):
    n = numbered(v.hit_findings(spark, sf), "skill_id", ["path"], [F.col("line"), F.col("pos")], "finding_index")
    return n.select("skill_id", "path", F.col("line").cast("long").alias("line"), "evidence", F.col("finding_index").cast("long").alias("finding_index"))


@query
def anti_duplicate_hits(spark, sf):
    h = v.hit_findings(spark, sf)
    return rules.drop_duplicate_hits(h, h.filter("severity in ('HIGH', 'CRITICAL')").withColumn("evidence", F.lit("ending"))).select(
        "skill_id", "path", F.col("line").cast("long").alias("line"), "evidence")


@query
def package_severity(spark, sf):
    return scores.severity_summary(v.hit_findings(spark, sf))


@query
def package_flags(spark, sf):
    f = scores.package_flags(v.script_flags(spark, sf))
    return f.select("skill_id", "has_obfuscation", "has_encoded_payloads", "has_dynamic_execution", r6("mean_analyzability").alias("mean_analyzability"), "min_analyzability", "n_files")


@query
def severity_score_logistic(spark, sf):
    return scores.code_threat(v.hit_findings(spark, sf), "path").select("path", r6("code_threat").alias("code_threat"), "n_findings")


def _document_verdicts(spark, sf):
    t = scores.code_threat(v.hit_findings(spark, sf).drop("skill_id").withColumnRenamed("path", "skill_id"))
    docs = v.files(spark, sf).select(F.col("path").alias("skill_id")).join(t, "skill_id", "left")
    p = F.coalesce("code_threat", F.lit(0.0))
    return docs.select("skill_id", p.alias("code_threat"), ver.ladder(p, fixed.THRESHOLDS_A, strict=False).alias("verdict"))


@query
def verdict_ladder(spark, sf):
    return _document_verdicts(spark, sf).select("skill_id", r6("code_threat").alias("code_threat"), "verdict")


@query
def batch_summary(spark, sf):
    return ver.batch_summary(_document_verdicts(spark, sf))


@query
def worst_verdict(spark, sf):
    return ver.worst_verdict(_document_verdicts(spark, sf))


def _judged(spark, sf):
    lab = v.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("skill_id"), (F.col("toxic") == 1).alias("is_malicious"))
    return ver.label_join(_document_verdicts(spark, sf), lab)


@query
def label_outcomes(spark, sf):
    return _judged(spark, sf).select("skill_id", "verdict", "is_malicious", "flagged", "outcome")


@query
def confusion_matrix(spark, sf):
    m = ver.confusion_matrix(_judged(spark, sf))
    return m.select("tp", "tn", "fp", "fn", *[r6(x).alias(x) for x in ("precision", "recall", "fpr", "accuracy", "f1")])


# ------------------------------------------------------------------------------ URLs


@query
def url_domains(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", c.url_domain(F.col("url")).alias("domain"))


@query
def external_url_distinct(spark, sf):
    io = v.script_io(spark, sf)
    return rep.external_urls(io).select("skill_id", "url")


@query
def urls_to_check(spark, sf):
    u = rep.distinct_urls(v.urls(spark, sf))
    return rep.urls_to_check(u).select("skill_id", "url")


@query
def reputation_join(spark, sf):
    n = F.length("url")
    u = rep.distinct_urls(v.urls(spark, sf))
    rows = u.select("url").distinct()
    table = rows.select("url", F.when(n % 3 == 0, n % 5).otherwise(0).cast("int").alias("malicious"), (n % 2).cast("int").alias("suspicious"), F.lit(2).alias("harmless"),
                        (n % 7).cast("int").alias("undetected"), F.concat(F.lit("link:"), "url").alias("permalink"))
    return rep.reputation_findings(rep.urls_to_check(u), table).select("skill_id", "severity", "evidence", r6("confidence").alias("confidence"))


# ----------------------------------------------------------------------------- steps


@query
def steps_described(spark, sf):
    s = v.steps(spark, sf)
    return s.select("skill_id", F.col("step_index").cast("long").alias("step_index"), "step_id", "action", "target_script", F.array_join("input_refs", ",").alias("input_refs"),
                    "output_name", "declared_scope", "condition", "branch_true", "branch_false")


@query
def steps_extracted(spark, sf):
    """Steps read back from the derived instruction files."""
    s = stp.extract_steps(man.manifest_fields(src.manifest_file(v.manifest_files(spark, sf))))
    return s.select("skill_id", F.col("step_index").cast("long").alias("step_index"), "description", "target_script")


@query
def manifest_fields(spark, sf):
    return man.manifest_fields(v.manifest_files(spark, sf)).select("skill_id", "has_frontmatter", "name", "description", "version")


@query
def manifest_permissions(spark, sf):
    return man.permissions(v.manifest_files(spark, sf)).select("skill_id", "perm_type", "scope")


@query
def nested_permissions(spark, sf):
    """Permissions that stand in nested maps and lists of maps, with the keys they stand under."""
    files = v.nested_manifest_files(spark, sf)
    keys = man.front_paths(files).filter("keys[0] = 'permissions'").select("skill_id", "pos", F.array_join("keys", ".").alias("keys"), F.col("value").alias("scope"))
    kinds = man.permissions(files).select("skill_id", "pos", "perm_type", "scope")
    return keys.join(kinds, ["skill_id", "pos", "scope"]).select("skill_id", F.col("pos").cast("long").alias("pos"), "keys", "perm_type", "scope")


@query
def manifest_findings(spark, sf):
    files = v.packages(spark, sf)
    m = src.manifest_file(files)
    f = man.validate_manifest(m, man.manifest_fields(m), man.permissions(m), files).unionByName(src.missing_manifest_findings(files))
    return f.select("skill_id", "severity", "category", "description", "evidence")


@query
def step_upstream(spark, sf):
    return taint.step_upstream(v.steps(spark, sf)).select("skill_id", F.col("step_index").cast("long").alias("step_index"), F.col("up_index").cast("long").alias("up_index"))


@query
def sibling_flow_edges(spark, sf):
    return g.sibling_edges(v.units(spark, sf)).select("skill_id", "from_id", "to_id", "label")


@query
def step_taint_labels(spark, sf):
    st, io, fl = v.steps(spark, sf), v.script_io(spark, sf), v.script_flags(spark, sf)
    linked = contracts.step_script(st, fl)
    seeds = taint.step_seeds(linked, io)
    m = taint.taint_map(st, seeds, taint.blocked_steps(linked, io, fl))
    return m.select("skill_id", F.col("step_index").cast("long").alias("step_index"), F.array_join(F.array_sort("labels"), ",").alias("labels"))


@query
def taint_chains(spark, sf):
    st = v.steps(spark, sf)
    purpose = st.select("skill_id").distinct().withColumn("purpose", F.lit("Collects shop data"))
    t = taint.taint_chains(st, purpose, v.script_io(spark, sf), v.script_flags(spark, sf))
    return t.select("skill_id", "label", "detail", "origin_step", "sink_type", "sink_detail", "dest_script", "dest_step", F.array_join("step_path", ",").alias("step_path"), "severity", "declared")


@query
def step_script_links(spark, sf):
    j = contracts.step_script(v.steps(spark, sf), v.script_flags(spark, sf))
    return j.select("skill_id", "step_id", "script")


@query
def steps_for_script(spark, sf):
    j = contracts.steps_for_script(v.script_flags(spark, sf), v.steps(spark, sf))
    return j.select("skill_id", "path", F.array_join("step_list", ",").alias("steps"))


@query
def contracts_inferred(spark, sf):
    st = v.steps(spark, sf)
    m = man.manifest_fields(v.manifest_files(spark, sf))
    p = man.permissions(v.manifest_files(spark, sf))
    k = contracts.infer_contracts(st, m, p)
    j = lambda x: F.array_join(F.array_sort(x), ",").alias(x)
    return k.select("skill_id", "step_id", j("allowed_file_reads"), j("allowed_file_writes"), j("allowed_network"), j("allowed_subprocesses"), "sensitive_ok", "network_ok")


@query
def contract_violations(spark, sf):
    x = contracts.verify_contracts(v.steps(spark, sf), v.contracts(spark, sf), v.script_io(spark, sf), v.script_flags(spark, sf))
    return x.groupBy("skill_id", "step_id", "script", "check", "violation_type", "severity").agg(F.count("*").alias("n"), r6(F.max("confidence")).alias("confidence"))


@query
def contract_scores(spark, sf):
    x = contracts.verify_contracts(v.steps(spark, sf), v.contracts(spark, sf), v.script_io(spark, sf), v.script_flags(spark, sf))
    return scores.contract_score(x).select("skill_id", r6("contract_score").alias("contract_score"), "n_violations", "critical_contract")


@query
def phantom_scripts(spark, sf):
    st = v.steps(spark, sf)
    return contracts.phantom_scripts(v.script_flags(spark, sf), stp.program_summary(st), st)


@query
def enriched_findings(spark, sf):
    st = v.steps(spark, sf)
    e = v.op_columns(v.event_rows(spark, sf))
    t = F.col("event_type")
    cat = (F.when(t == "click", "DataExfiltration").when(t == "error", "CommandInjection").when(t == "view", "CredentialTheft")
           .when(t == "purchase", "EnvHijacking").otherwise("Obfuscation"))
    f = findings(e.withColumn("line", (F.col("event_id") % v.BLOCK + 1)), "code", F.when(F.col("k") % 3 == 0, "HIGH").otherwise("MEDIUM"), cat, "code finding",
                 path=F.col("path"), line=F.col("line"), evidence=F.col("cmd"))
    x = contracts.enrich_findings(f, st, stp.program_summary(st), v.contracts(spark, sf))
    return x.groupBy("skill_id", "path", "category", "severity", F.coalesce("original_severity", F.lit("-")).alias("was"),
                     F.coalesce("enrichment_action", F.lit("-")).alias("action")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ code from scripts


def _parsed(files):
    """The scan of the scripts, made once: every branch of a query reads its own columns of what was written."""
    return written(py.parse(files), "parsed")


def _tokens(spark, sf):
    return py.tokens(py.parse(v.script_files(spark, sf)))


@query
def python_code_ops(spark, sf):
    files = v.script_files(spark, sf)
    o = py.code_ops(py.tokens(py.parse(files)), files.filter("ext = '.md'"))
    return o.select("skill_id", "path", F.col("line").cast("long").alias("line"), "op_type", "label", "file_path", "url", "cmd", "var_name", "is_write", "is_sensitive", "is_external", "cmd_dynamic",
                    r6("risk").alias("risk"))


@query
def python_script_io(spark, sf):
    pyf = _parsed(v.script_files(spark, sf))
    t = py.tokens(pyf)
    io = py.python_io(written(py.calls(t), "calls"), py.string_literals(t), py.path_divisions(pyf), py.imports(pyf), pyf)
    return io.groupBy("skill_id", "path", "kind", "subtype", "detail").agg(F.count("*").alias("n"))


@query
def python_call_findings(spark, sf):
    f = py.call_findings(py.calls(_tokens(spark, sf)))
    return f.groupBy("skill_id", "path", F.col("line").cast("long").alias("line"), "severity", "category", "description", "evidence").agg(F.count("*").alias("n"))


@query
def python_file_flags(spark, sf):
    pyf = _parsed(v.script_files(spark, sf))
    t = py.tokens(pyf)
    return py.python_flags(pyf, py.calls(t), py.string_literals(t), py.imports(pyf))


@query
def page_script_facts(spark, sf):
    """JavaScript facts of the raw pages, each with a script that calls its own address."""
    script = F.concat(F.lit("\n<script>\nfetch('"), "url", F.lit("');\nconst t = process.env['token']; spawn(t);\n</script>"))
    p = v.table(spark, sf, "pages").select(c.url_domain(F.col("url")).alias("skill_id"), F.col("page_id").cast("string").alias("path"), F.lit(".js").alias("ext"), F.concat("html", script).alias("content"))
    io = other_code.js_io(p)
    after = F.when(F.col("line") > 0, F.lit(True)).otherwise(False)
    return io.select("skill_id", "path", "kind", "subtype", "detail", after.alias("has_line")).groupBy("skill_id", "path", "kind", "subtype", "detail", "has_line").agg(F.count("*").alias("n"))


@query
def other_code_facts(spark, sf):
    """Facts of derived JavaScript and shell files."""
    f = v.page_files(spark, sf)
    io = other_code.js_io(f).unionByName(other_code.shell_io(f))
    return io.groupBy("skill_id", "path", "kind", "subtype", "detail").agg(F.count("*").alias("n"))


@query
def other_code_findings(spark, sf):
    f = v.page_files(spark, sf)
    x = other_code.other_findings(f).unionByName(rules.line_findings(f))
    return x.groupBy("skill_id", "path", "analyzer", "severity", "category").agg(F.count("*").alias("n"))


@query
def other_code_flags(spark, sf):
    return other_code.other_flags(v.page_files(spark, sf)).select("skill_id", "path", "analyzability", "has_dynamic_execution")


@query
def registered_checks(spark, sf):
    from packaudit.operators.checks import run_checks

    files = v.packages(spark, sf)
    m = src.manifest_file(files)
    f = run_checks({"files": files, "manifest": man.manifest_fields(m), "permissions": man.permissions(m)})
    return f.select("skill_id", "analyzer", "severity", "path", F.col("line").cast("long").alias("line"), "description")


@query
def isolated_checks(spark, sf):
    """The built-in checks beside two that fail: one while it is planned, one in a task, on a
    single row of thousands."""
    from packaudit.operators.checks import registered, run_checks

    files = v.packages(spark, sf)
    m = src.manifest_file(files)

    def sizes(tables):
        bad = (F.col("path") == "SKILL.md") & (F.col("skill_id") == "u7")
        text = F.when(bad, F.raise_error(F.lit("no size for u7"))).otherwise(F.concat(F.lit("Size "), F.col("size").cast("string")))
        return findings(tables["files"], "sizes", "LOW", "Unknown", text, path=F.col("path"))

    checks = {"sizes": sizes, **registered(), "missing": lambda tables: tables["files"].select("no_such_column"), "counts": lambda tables: findings(tables["files"].filter("path = 'SKILL.md'"), "counts", "LOW", "Unknown", "Has a manifest", path=F.col("path"))}
    f = run_checks({"files": files, "manifest": man.manifest_fields(m), "permissions": man.permissions(m)}, checks)
    text = F.when(F.col("analyzer") == "missing", F.substring("description", 1, 23)).otherwise(F.col("description"))  # the planner's own words follow
    return f.select("skill_id", "analyzer", "severity", "path", F.col("line").cast("long").alias("line"), text.alias("description"))


def _odd_parsed(spark, sf):
    return py.parse(v.odd_scripts(spark, sf))


@query
def call_tree(spark, sf):
    """Every call of the odd scripts with the call around it, five deep and more."""
    t = py.call_tree(_odd_parsed(spark, sf))
    up = t.select("skill_id", "path", F.col("call").alias("parent"), F.col("fn").alias("parent_fn"))
    j = t.join(up, ["skill_id", "path", "parent"], "left")
    return j.select("skill_id", "path", F.col("line").cast("long").alias("line"), "fn", F.col("depth").cast("long").alias("depth"), F.coalesce("parent_fn", F.lit("")).alias("parent_fn"))


@query
def calls_inside_eval(spark, sf):
    """Calls in the arguments of eval(), however deep."""
    x = py.inside_arguments(py.call_tree(_odd_parsed(spark, sf)), F.col("fn") == "eval")
    return x.groupBy("skill_id", "path", "fn").agg(F.count("*").alias("n"))


@query
def odd_call_findings(spark, sf):
    """Nested reads, paths built from parts and attributes fetched by name."""
    f = py.call_findings(py.calls(py.tokens(_odd_parsed(spark, sf))))
    return f.select("skill_id", "path", F.col("line").cast("long").alias("line"), "severity", "category", "description")


@query
def path_divisions(spark, sf):
    d = py.path_divisions(_odd_parsed(spark, sf))
    return d.select("skill_id", "path", F.col("line").cast("long").alias("line"), "joined")


@query
def reverse_shell_files(spark, sf):
    f = py.reverse_shells(py.calls(py.tokens(_odd_parsed(spark, sf))))
    return f.select("skill_id", "path", "severity", "category", F.col("line").cast("long").alias("line"), "confidence")


@query
def embedded_code_ops(spark, sf):
    """Python-like calls found inside the derived scripts when they are read as plain text."""
    o = py.embedded_ops(v.script_files(spark, sf))
    return o.select("skill_id", "path", F.col("line").cast("long").alias("line"), "label")


@query
def file_analyzability(spark, sf):
    a = py.analyzability(py.parse(v.script_files(spark, sf)))
    return a.select("skill_id", "path", r6("analyzability").alias("analyzability"))


# ---------------------------------------------------------------------- graph and ops


@query
def op_risks(spark, sf):
    return v.ops(spark, sf).select("id", "op_type", r6(py.op_risk()).alias("risk"))


@query
def op_score_topn(spark, sf):
    t = scores.top_op_findings(scores.op_scores(v.ops(spark, sf)), 10)
    return t.select("skill_id", "id", r6("score").alias("score"), "description")


@query
def hiding_scores(spark, sf):
    return scores.hiding_score(v.ops(spark, sf)).select("skill_id", r6("hiding_score").alias("hiding_score"))


@query
def ctrl_flow_edges(spark, sf):
    return g.ctrl_flow_edges(v.ops(spark, sf)).select("skill_id", "from_id", "to_id")


@query
def reach_within_k(spark, sf):
    o = v.ops(spark, sf).withColumn("path", F.lit("one"))
    file = F.floor((F.regexp_extract("id", "([0-9]+)", 1).cast("long")) / 8192).cast("string")
    o = o.withColumns({"path": file, "seq": F.regexp_extract("id", "([0-9]+)", 1).cast("long")})
    hit = reach.follow_within(o, g.is_sensitive_read(), g.is_external_call(), 6, [F.col("id"), F.col("url")], order=("seq",))
    return hit.select("skill_id", F.col("id").alias("source"), F.col("target.id").alias("target"), F.col("target.url").alias("url"))


@query
def flow_chain_targets(spark, sf):
    """The nearest external call that a sensitive read reaches within six edges that branch and
    run in circles, and the nearest dynamic call of every fetch within five."""
    from pyspark.sql import Window

    o = v.ops(spark, sf).withColumn("seq", F.regexp_extract("id", "([0-9]+)", 1).cast("long"))
    w = Window.partitionBy("skill_id", F.floor(F.col("seq") / 8192)).orderBy("seq")
    ways = F.array(F.when(F.col("seq") % 3 != 0, F.lead("id", 1).over(w)), F.when(F.col("seq") % 4 == 1, F.lead("id", 2).over(w)), F.when(F.col("seq") % 5 == 0, F.lag("id", 3).over(w)))
    edges = o.select("skill_id", F.col("id").alias("from_id"), ways.alias("ways")).select("skill_id", "from_id", F.explode(F.array_compact("ways")).alias("to_id"))
    out = []
    for key, (start, end) in g._chain_ends().items():
        hit = reach.nearest_targets(o.filter(start), o.filter(end), edges, fixed.OP_CHAIN_REACH[key], ["path", "line", "pos"])
        out.append(hit.select("skill_id", F.lit(key).alias("kind"), F.col("id").alias("source"), F.col("depth").cast("long").alias("depth"), F.col("target.id").alias("target")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def op_chains(spark, sf):
    x = g.dedupe_chains(g.op_chains(v.ops(spark, sf)))
    return x.select("skill_id", "category", "severity", "node")


@query
def declared_scopes(spark, sf):
    d = g.declared_scopes(v.units(spark, sf))
    return d.select("skill_id", *[F.array_join(x, ",").alias(x) for x in g.DIMS], "sensitive_access")


def _judged_ops(spark, sf):
    u = v.units(spark, sf)
    return g.best_step(g.declared_ops(v.ops(spark, sf), g.declared_scopes(u)), g.step_anchors(u))


@query
def declared_ops(spark, sf):
    return _judged_ops(spark, sf).select("skill_id", "id", "declared", F.col("anchor").cast("long").alias("anchor"))


@query
def misalign_edges(spark, sf):
    return g.cross_edges(_judged_ops(spark, sf)).select("skill_id", "from_id", "to_id", "edge_type", "label", r6("weight").alias("weight"))


@query
def covers_edges(spark, sf):
    return g.covers_edges(v.ops(spark, sf), v.permissions(spark, sf)).select("skill_id", "to_id", "label")


@query
def graph_stats(spark, sf):
    o = v.ops(spark, sf)
    return g.graph_stats(g.nodes(v.units(spark, sf), o, v.permissions(spark, sf)), g.ctrl_flow_edges(o).unionByName(g.sibling_edges(v.units(spark, sf))))


@query
def code_capabilities(spark, sf):
    return g.code_capabilities(v.ops(spark, sf)).select("skill_id", "dim", "scope")


def _all_packages(spark, sf):
    """Packages with code, with instruction units, or with both."""
    return v.units(spark, sf).select("skill_id").union(v.ops(spark, sf).select("skill_id")).distinct()


def _all_declared(spark, sf):
    declared = _all_packages(spark, sf).join(g.declared_scopes(v.units(spark, sf)), "skill_id", "left")
    return g.declared_long(g._scopes_or_empty(declared))


@query
def fuzzy_overlap(spark, sf):
    caps = g.code_capabilities(v.ops(spark, sf)).filter(F.col("dim").isin(g.DIMS))
    return g.fuzzy_overlap(_all_declared(spark, sf), caps, ["skill_id", "dim"]).select("skill_id", "dim", r6("similarity").alias("similarity"))


@query
def over_reach_gaps(spark, sf):
    return g.over_reach_rows(g.code_capabilities(v.ops(spark, sf)), _all_declared(spark, sf)).select("skill_id", "dim", "scope", r6("weight").alias("weight"), "gap")


@query
def alignment_scores(spark, sf):
    ops, units = written(v.ops(spark, sf), "ops"), written(v.units(spark, sf), "units")  # read four times below
    scopes = written(g.declared_scopes(units), "scopes")
    mis = g.cross_edges(g.best_step(g.declared_ops(ops, scopes), g.step_anchors(units))).filter("edge_type = 'misalign'")
    packages = units.select("skill_id").union(ops.select("skill_id")).distinct()
    al = v.script_flags(spark, sf).groupBy("skill_id").agg(F.min("analyzability").alias("analyzability"))
    a = g.alignment(packages, written(g.code_capabilities(ops), "caps"), scopes, mis, al)
    return a.select("skill_id", r6("over_reach").alias("over_reach"), r6("align_score").alias("align_score"), "misalign_count", r6("alignment_gap").alias("alignment_gap"))


@query
def taint_fixed_point(spark, sf):
    """Taint over supplied data-flow edges: every other control-flow edge is one."""
    o = v.ops(spark, sf)
    num = lambda x: F.regexp_extract(x, "([0-9]+)", 1).cast("long")
    e = g.ctrl_flow_edges(o.withColumn("path", F.floor(num("id") / 8192).cast("string")).withColumn("line", num("id")))
    flows = e.withColumn("edge_type", F.when(num("from_id") % 3 != 0, "data_flow").otherwise("ctrl_flow"))
    hit = g.propagate_taint(o, flows)
    return hit.select("skill_id", "id")


@query
def step_order(spark, sf):
    """Breadth-first distance of each unit from its package's first over the flow edges."""
    u = v.units(spark, sf)
    starts = u.groupBy("skill_id").agg(F.min("step_index").alias("i")).select("skill_id", g.nl_id(F.col("i")).alias("id"))
    d = reach.closure(starts, g.sibling_edges(u))
    return d.select("skill_id", "id", F.col("depth").cast("long").alias("depth"))


@query
def step_escalation(spark, sf):
    u = v.units(spark, sf)
    mis = g.cross_edges(_judged_ops(spark, sf)).filter("edge_type = 'misalign'")
    return g.step_escalation(u, g.sibling_edges(u), mis).select("skill_id", "severity", "category", "node", "description")


# --------------------------------------------------------------------- stages, chains


@query
def script_stages(spark, sf):
    s = chains.stages_per_script(v.script_io(spark, sf), v.script_flags(spark, sf))
    return s.select("skill_id", "path", F.array_join("stages", ",").alias("stages"))


@query
def package_stages(spark, sf):
    s = chains.package_stages(chains.stages_per_script(v.script_io(spark, sf), v.script_flags(spark, sf))).withColumn("k", chains.classify_chain())
    return s.select("skill_id", "n_scripts", F.array_join("stages", ",").alias("stages"), "k.chain_type", "k.severity")


@query
def text_stages(spark, sf):
    s = chains.stages_from_text(v.files(spark, sf), ["skill_id", "path"], "content").withColumn("k", chains.classify_chain())
    return s.select("skill_id", "path", F.array_join("stages", ",").alias("stages"), "k.chain_type")


@query
def attack_chains(spark, sf):
    a = chains.attack_chains(v.script_io(spark, sf), v.script_flags(spark, sf), v.steps(spark, sf))
    return a.select("skill_id", "chain_type", F.array_join("stages", ",").alias("stages"), "severity", "script", "n_scripts", "n_steps", "confidence")


@query
def chain_scores(spark, sf):
    a = chains.attack_chains(v.script_io(spark, sf), v.script_flags(spark, sf), v.steps(spark, sf))
    return scores.chain_score_a(a).select("skill_id", r6("chain_score").alias("chain_score"), "complete_chain")


# ------------------------------------------------------------------ scores and fusion


@query
def class_gap(spark, sf):
    d = scores.declared_classes(v.steps(spark, sf))
    x = scores.class_gap(scores.observed_classes(v.script_io(spark, sf), v.script_flags(spark, sf)), d)
    return x.select("skill_id", F.array_join("observed", ",").alias("observed"), F.array_join("declared", ",").alias("declared"), r6("class_gap").alias("class_gap"))


@query
def check_scores(spark, sf):
    return scores.check_score(v.hit_findings(spark, sf)).select("skill_id", r6("check_score").alias("check_score"))


@query
def filtered_scores(spark, sf):
    rows = numbered(v.hit_findings(spark, sf), "skill_id", ["path"], [F.col("line"), F.col("pos")], "finding_index")
    n = v.files(spark, sf).groupBy("skill_id").agg(F.count("*").alias("n"))
    verdicts = rows.join(n, "skill_id").filter("finding_index % 2 = 0").select(
        "skill_id", "finding_index", ((F.col("finding_index") + F.col("n")) % 3 == 0).alias("is_genuine"), F.lit("seen").alias("reasoning"))
    x = scores.apply_finding_verdicts(rows, verdicts)
    return scores.filtered_score(x).select("skill_id", r6("filtered_score").alias("filtered_score"))


@query
def judge_consensus(spark, sf):
    return scores.judge_consensus(v.judge_verdicts(spark, sf)).select("skill_id", r6("judge_score").alias("judge_score"))


@query
def flagged_units(spark, sf):
    f = scores.flagged_units(v.unit_scores(spark, sf), v.units(spark, sf))
    return f.select("skill_id", F.col("step_index").cast("long").alias("step_index"), "text", "category", r6("score").alias("score"))


@query
def unit_rollup(spark, sf):
    us = v.unit_scores(spark, sf)
    uc = us.select("skill_id").distinct().withColumns({"kill_chain": F.length("skill_id") % 2 == 0, "kill_chain_text": F.lit("told")})
    return scores.unit_rollup(us, uc).select("skill_id", *[r6(x).alias(x) for x in ("i_mis", "i_exp", "i_exf", "i_cam", "i_priv")], r6("unit_score").alias("unit_score"))


@query
def fusion_a(spark, sf):
    x = ver.decide_a(ver.fuse_a(v.component_scores(spark, sf)))
    return x.select("skill_id", r6("overall").alias("overall"), r6("decided").alias("decided"), "verdict", r6("confidence").alias("confidence"))


@query
def fusion_b(spark, sf):
    x = ver.decide_b(ver.fuse_b(v.component_scores(spark, sf)))
    return x.select("skill_id", r6("p").alias("p"), "verdict", "severity", r6("confidence").alias("confidence"))


@query
def gate_filter(spark, sf):
    x = ver.fast_gate(v.component_scores(spark, sf))
    return x.select("skill_id", r6("fast_p").alias("fast_p"), "needs_judges")


@query
def static_overall(spark, sf):
    s = v.component_scores(spark, sf)
    return s.select("skill_id", r6(scores.static_overall(*[F.col(x) for x in ("s2", "s3", "s_chain", "s_check")])).alias("static_overall"))


def _told_chains(spark, sf):
    """Kill chains from the strongest operations, flagged turns, judge rows and derived package scores."""
    us = v.unit_scores(spark, sf)
    n = F.regexp_extract("skill_id", "([0-9]+)", 1).cast("int")
    pk = us.select("skill_id").distinct()
    table = pk.select("skill_id", ((n % 10) / 10.0).alias("p"), ((n % 7) / 7.0).alias("s3"), ((n % 3) / 3.0).alias("over_reach"),
                      (n % 5).cast("long").alias("misalign_count"), ((n % 4) / 4.0).alias("hiding_score"))
    told = pk.select("skill_id", (n % 2 == 0).alias("kill_chain"), F.lit("told").alias("kill_chain_text"))
    top = scores.top_op_findings(scores.op_scores(v.ops(spark, sf)))
    return ver.kill_chains(table, top, scores.flagged_units(us, v.units(spark, sf)), scores.unit_rollup(us, told), v.package_judges(spark, sf))


@query
def kill_chains(spark, sf):
    return _told_chains(spark, sf)["chains"].select("skill_id", "name", "severity", "misalign_count", "n_code", "n_nl", "strategy")


@query
def kill_chain_evidence(spark, sf):
    """All evidence of the kill chains, counted by what is quoted."""
    e = _told_chains(spark, sf)["evidence"]
    return e.groupBy("skill_id", "name", "side", "text").agg(F.count("*").alias("n"))


@query
def evidence_union(spark, sf):
    st, io, fl = written(v.steps(spark, sf), "steps"), written(v.script_io(spark, sf), "script_io"), written(v.script_flags(spark, sf), "script_flags")
    viol = contracts.verify_contracts(st, v.contracts(spark, sf), io, fl)
    flows = taint.taint_chains(st, st.select("skill_id").distinct().withColumn("purpose", F.lit("Collects shop data")), io, fl)
    found = py.call_findings(py.calls(_tokens(spark, sf))).withColumn("enrichment_reason", F.lit(None).cast("string"))
    ph = contracts.phantom_scripts(fl, stp.program_summary(st), st)
    e = ver.evidence(viol, flows, found, ph, chains.attack_chains(io, fl, st))
    return e.groupBy("skill_id", "evidence_type", "severity", F.col("rank").cast("long").alias("rank")).agg(F.count("*").alias("n"))


# ----------------------------------------------------------------------- whole audits


@query
def audit_declared_vs_observed(spark, sf):
    """Audit A over the derived packages: one report row per package."""
    r = crossmodal.audit(v.packages(spark, sf))["reports"]
    return r.select("skill_id", "verdict", r6("overall").alias("overall"), r6("confidence").alias("confidence"), "n_findings", "n_violations", "n_taint", "n_phantoms", "n_evidence")


@query
def audit_package_graph(spark, sf):
    """Audit B over the derived packages with the turns as parsed instructions."""
    r = graph_audit.audit(v.packages(spark, sf), v.units(spark, sf), unit_scores=v.unit_scores(spark, sf))["reports"]
    return r.select("skill_id", "verdict", "severity", r6("p").alias("p"), r6("s2").alias("s2"), r6("s3").alias("s3"), r6("fast_p").alias("fast_p"), "needs_judges", "misalign_count", "n_findings")


# ------------------------------------------------------ selections, summaries, context


@query
def binary_files(spark, sf):
    """Documents as raw files: some begin with the mark of a program, some hold a zero byte."""
    d = v.table(spark, sf, "documents")
    n = F.col("doc_id")
    raw = F.when(n % 7 == 0, F.concat(F.unhex(F.lit("7F454C46")), F.col("text").cast("binary"))).when(n % 5 == 0, F.concat(F.unhex(F.lit("610062")), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    name = F.concat(F.when(n % 4 == 3, ".d").otherwise("d"), n.cast("string"), F.when(n % 4 == 0, ".py").when(n % 4 == 1, ".png").otherwise(""))
    f = src._shape(d.select(F.col("source").alias("skill_id"), F.concat(F.lit("files/"), name).alias("path"), F.octet_length(raw).cast("long").alias("length"), raw.alias("content")), fixed.TEXT_EXTENSIONS, F.lit(True))
    found = src.binary_findings(f).select("skill_id", "path", "description")
    return f.join(found, ["skill_id", "path"], "left").select("skill_id", "path", "ext", "is_binary", F.coalesce(F.char_length("content"), F.lit(-1)).cast("long").alias("chars"), F.coalesce("description", F.lit("")).alias("finding"))


@query
def source_selections(spark, sf):
    """Which files the injection and embedded-code scans look at."""
    f = v.packages(spark, sf).unionByName(v.page_files(spark, sf))
    one = src.injection_files(f).select("skill_id", "path", F.lit("injection").alias("scan"), F.col("file_order").cast("long").alias("place"))
    two = src.injection_sources(f).select("skill_id", "path", F.lit("sources").alias("scan"), F.lit(0).cast("long").alias("place"))
    three = src.non_python_sources(f).select("skill_id", "path", F.lit("beside code").alias("scan"), F.lit(0).cast("long").alias("place"))
    return one.unionByName(two).unionByName(three)


@query
def supplied_contracts(spark, sf):
    """Contracts that a table supplies for every other package win over those inferred."""
    m, p = man.manifest_fields(v.manifest_files(spark, sf)), man.permissions(v.manifest_files(spark, sf))
    even = F.regexp_extract("skill_id", "([0-9]+)", 1).cast("int") % 2 == 0
    k = contracts.prefer_supplied(contracts.infer_contracts(v.steps(spark, sf), m, p), v.contracts(spark, sf).filter(even))
    j = lambda x: F.array_join(F.array_sort(x), ",").alias(x)
    return k.select("skill_id", "step_id", j("allowed_file_reads"), j("allowed_file_writes"), j("allowed_network"), j("allowed_subprocesses"), "sensitive_ok", "network_ok")


@query
def wrapper_probes(spark, sf):
    """Packages whose instruction text or scripts hold the mark of a wrapped input."""
    f = v.phrased_texts(spark, sf)
    n = F.col("path").cast("long") % 3
    return inj.probe_hits(f.withColumn("path", F.when(n == 0, "SKILL.md").when(n == 1, F.concat(F.lit("scripts/d"), "path", F.lit(".py"))).otherwise(F.concat(F.lit("lib/deep/d"), "path", F.lit(".py")))))


@query
def instruction_graph(spark, sf):
    """Nodes, flow edges and declared scopes from the instructions alone."""
    n, e, scopes = g.instruction_graph(v.units(spark, sf))
    node = n.groupBy("skill_id", F.col("node_type").alias("kind")).agg(F.count("*").alias("n"))
    edge = e.groupBy("skill_id", F.col("label").alias("kind")).agg(F.count("*").alias("n"))
    dims = g.declared_long(scopes).select("skill_id", F.col("dim").alias("kind"), F.size("declared").cast("long").alias("n"))
    return node.unionByName(edge).unionByName(dims)


@query
def package_summaries(spark, sf):
    fields = man.manifest_fields(v.manifest_files(spark, sf))
    x = crossmodal.package_summary(fields, v.steps(spark, sf), v.script_files(spark, sf), v.script_io(spark, sf), v.script_flags(spark, sf))
    n = lambda k: F.coalesce(k, F.lit(0)).cast("long").alias(k)
    b = lambda k: F.coalesce(k, F.lit(False)).alias(k)
    return x.select("skill_id", F.coalesce("skill_name", F.lit("-")).alias("skill_name"), *map(n, ("step_count", "linked_steps", "scripts_found", "sensitive_reads", "network_destinations")),
                    *map(b, ("has_obfuscation", "has_encoded_payloads", "has_dynamic_execution")))


@query
def context_lines(spark, sf):
    """What a package declares against what its code does, as lines."""
    c_ = v.component_scores(spark, sf).select(F.concat(F.lit("u"), "skill_id").alias("skill_id"), "s2", "s3")
    lines = g.context_lines(g.declared_scopes(v.units(spark, sf)), g.code_capabilities(v.ops(spark, sf)), _judged_ops(spark, sf), c_)
    return lines.groupBy("skill_id", "section", "text").agg(F.count("*").alias("n"))


@query
def external_hosts(spark, sf):
    """Whether hosts that code connects to lie outside: names, addresses and hints of variables."""
    p = v.table(spark, sf, "pages").select("page_id", c.url_domain(F.col("url")).alias("domain"))
    i = F.col("page_id")
    s = lambda x: F.concat(*[y if isinstance(y, Column) else F.lit(y) for y in x])
    n = (i % 200).cast("string")
    forms = [F.col("domain"), s(["10.0.", n, ".1"]), s(["172.", (i % 40).cast("string"), ".0.9"]), s(["8.8.8.", (i % 300).cast("string")]), s(["printer", n, ".local"]), s(["<c2_host", n, ">"]),
             s(["<target", n, ">"]), F.lit("fe80::1"), F.lit(" LocalHost "), F.lit(""), s(["192.168.", n, ".7"]), s([((i % 60) + 200).cast("string"), ".1.2.3"])]
    host = F.element_at(F.array(*forms), ((F.floor(i / 2) % len(forms)) + 1).cast("int"))
    return p.select("page_id", host.alias("host")).withColumn("is_external", c.is_external_host(F.col("host")))


def _rare_ops(spark, sf):
    f = v.rare_scripts(spark, sf)
    return g.with_code_ids(py.code_ops(py.tokens(py.parse(f)), f.filter("ext = '.txt'")))


@query
def rare_code_ops(spark, sf):
    """Operations behind base64 constants, addresses in constants and start-up files."""
    return _rare_ops(spark, sf).groupBy("skill_id", "path", "op_type", "label", "is_write", "is_external").agg(F.count("*").alias("n"))


@query
def startup_writes(spark, sf):
    """Writes to start-up files as chains."""
    x = g.op_chains(_rare_ops(spark, sf)).filter(F.col("name") == fixed.OP_CHAINS["stay"][0])
    return x.select("skill_id", "path", F.col("line").cast("long").alias("line"), "severity", "category", "description")


@query
def embedded_resources(spark, sf):
    from packaudit.operators.manifest import audit_embedded

    f = audit_embedded({"files": v.rare_scripts(spark, sf)})
    return f.select("skill_id", "path", "severity", F.col("line").cast("long").alias("line"), "description")


@query
def script_imports(spark, sf):
    """Imported modules of each script, and whether it has a main guard."""
    p = py.parse(v.rare_scripts(spark, sf))
    return py.imports(p).join(p.select("skill_id", "path", "entry_point"), ["skill_id", "path"]).select("skill_id", "path", "module", "entry_point")
