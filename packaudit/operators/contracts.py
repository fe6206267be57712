"""What each step may do, and where its script does more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit.functions import columns as c
from packaudit.functions import fixed
from packaudit.functions.tables import union_all
from packaudit.operators.steps import script_links


def step_script(steps: DataFrame, scripts: DataFrame) -> DataFrame:
    """Steps with the script they name: the exact path, else the first file of that name.

    Both lookups have at most one partner per step, so many files of one name do not
    multiply rows.
    """
    linked = steps.filter("target_script <> ''")
    exact = scripts.select("skill_id", "path").distinct().withColumns({"target_script": F.col("path"), "exact": F.col("path")}).drop("path")
    named = scripts.withColumn("basename", c.basename(F.col("path"))).groupBy("skill_id", "basename").agg(F.min("path").alias("by_name"))
    j = linked.join(exact, ["skill_id", "target_script"], "left").withColumn("basename", c.basename(F.col("target_script")))
    j = j.join(named, ["skill_id", "basename"], "left").withColumn("script", F.coalesce("exact", "by_name"))
    return j.filter("script is not null").drop("exact", "by_name", "basename")


def steps_for_script(scripts: DataFrame, steps: DataFrame) -> DataFrame:
    """Steps that name each script, by file name; a package's steps are bounded by its manifest."""
    by_name = steps.filter("target_script <> ''").groupBy("skill_id", c.basename(F.col("target_script")).alias("basename")).agg(
        F.array_sort(F.collect_list("step_index")).alias("step_list"))
    rows = scripts.select("skill_id", "path").distinct().withColumn("basename", c.basename(F.col("path")))
    return rows.join(by_name, ["skill_id", "basename"]).drop("basename")


def infer_contracts(steps: DataFrame, manifest: DataFrame, perms: DataFrame) -> DataFrame:
    """Bounds per step from its wording, the tools the manifest names and its permissions."""
    scopes = perms.groupBy("skill_id").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("perm_type") == p, F.struct("pos", "scope")))), lambda s: s["scope"]).alias("p_" + p)
        for p in ("file_read", "file_write", "network")])
    tool = r"`(\w[\w.\-]*)`"
    using = F.regexp_extract(F.lower("description"), r"using\s+(.+?)(?:\.|$)", 1)
    named = F.concat(
        F.transform(c.all_matches(F.col("description"), tool), F.lower),
        F.filter(c.all_matches(using, r"(\w[\w\-]*)"), lambda t: ~t.isin(fixed.TOOL_STOP_WORDS)))
    tools = manifest.select("skill_id", named.alias("tools"))
    rows = steps.join(scopes, "skill_id", "left").join(tools, "skill_id", "left")
    d, low = F.col("description"), F.lower("description")
    none = c.empty_strings()
    broad = F.array(F.lit("**"))
    project = F.array(F.lit("project_dir/**"))
    near = c.has_any(low, ["project", "current", "cwd"])
    wide = ~near & c.has_any(low, fixed.SENSITIVE_WORDS)
    hinted = c.has_any(low, fixed.READ_HINTS)
    reads = F.when(hinted & wide, broad).when(hinted, project).otherwise(none)
    writes = F.when(c.has_word(d, fixed.WRITE_WORDS), project).otherwise(none)
    online = c.has_word(d, fixed.NETWORK_WORDS)
    url = c.first_match(d, r"(https?://[\w.\-/]+)")
    net = F.when(online, F.array(F.coalesce(url, F.lit("*")))).otherwise(none)
    own = F.when(F.col("target_script") != "", F.array(F.lit("python"), F.lit("python3"), F.col("target_script"))).otherwise(none)
    commands = F.array_sort(F.array_distinct(F.concat(
        c.all_matches(low, r"(?:run|execute|invoke|call|use)\s+(?:`)?(\w[\w.\-]*)(?:`)?"),
        F.transform(c.all_matches(d, tool), F.lower), F.coalesce("tools", none), own)))
    runs = F.when(c.has_word(d, fixed.PROCESS_WORDS), F.when(F.size(commands) > 0, commands).otherwise(F.array(F.lit("*")))).otherwise(none)
    add = lambda base, p: F.array_distinct(F.concat(base, F.coalesce("p_" + p, none)))
    return rows.select(
        "skill_id", "step_id", add(reads, "file_read").alias("allowed_file_reads"), add(writes, "file_write").alias("allowed_file_writes"),
        add(net, "network").alias("allowed_network"), runs.alias("allowed_subprocesses"), none.alias("allowed_env_vars"),
        ((hinted & wide) | c.has_word(d, fixed.SENSITIVE_WORDS)).alias("sensitive_ok"),
        (online | (F.size(F.coalesce("p_network", none)) > 0)).alias("network_ok"))


def prefer_supplied(inferred: DataFrame, supplied: DataFrame) -> DataFrame:
    """The supplied contract where there is one, else the inferred one."""
    keys = ["skill_id", "step_id"]
    have = supplied.select(*keys).distinct()
    return supplied.select(*inferred.columns).unionByName(inferred.join(have, keys, "left_anti"))


def path_covered(path: Column, allowed: Column) -> Column:
    """Whether a path lies within any allowed pattern: equal, below the project, or by wildcard."""
    p = F.lower(path)
    local = (~p.rlike(r"^[/~$]") & ~F.element_at(F.split(p, "/"), 1).contains(".")) | p.startswith("./") | p.startswith("scripts/")

    def fits(a: Column) -> Column:
        low = F.lower(a)
        return (low == p) | (low.startswith("project_dir") & local) | c.matches_glob(p, low) | a.isin("**", "*")

    return F.exists(allowed, fits)


def verify_contracts(steps: DataFrame, contracts: DataFrame, script_io: DataFrame, flags: DataFrame) -> DataFrame:
    """All violations: what a step's script does beyond the step's bounds."""
    linked = step_script(steps, flags).select("skill_id", "step_id", "step_index", "script", "description")
    bound = linked.join(contracts, ["skill_id", "step_id"]).withColumn("path", F.col("script"))
    acts = bound.join(script_io.select("skill_id", "path", "kind", "subtype", "detail"), ["skill_id", "path"])
    kind, sub, d = F.col("kind"), F.col("subtype"), F.col("detail")
    say = F.concat
    q = lambda x: F.to_json(F.col(x))
    reads_exp = say(F.lit("Allowed reads: "), q("allowed_file_reads"))
    is_read = (kind == "input") & (sub == "file_read")
    dyn = d == "<dynamic>"
    open_read = F.exists("allowed_file_reads", lambda a: a.isin("**", "*"))
    secret = c.is_sensitive_contract_path(d)
    covered = path_covered(d, F.col("allowed_file_reads"))
    is_net = (kind == "effect") & (sub == "network_request")
    any_net = (F.size("allowed_network") == 0) | F.array_contains("allowed_network", "*")
    in_net = F.exists("allowed_network", lambda a: F.lower(d).contains(F.lower(a)))
    is_proc = (kind == "effect") & (sub == "subprocess")
    cmd = F.when(dyn, d).otherwise(F.element_at(F.split(F.trim(d), r"\s+"), 1))
    cmd_ok = F.exists("allowed_subprocesses", lambda a: (cmd == a) | cmd.endswith(F.concat(F.lit("/"), a)))
    no_procs = F.size("allowed_subprocesses") == 0

    def v(test, check, kind_, severity, text, expected, actual, confidence):
        return F.when(test, F.struct(
            F.lit(check).alias("check"), F.lit(kind_).alias("violation_type"), F.lit(severity).alias("severity"), text.alias("violation"),
            expected.alias("expected"), actual.alias("actual"), F.lit(confidence).alias("confidence")))

    lit_, sure = F.lit, fixed.VIOLATION_CONFIDENCE
    checks = F.array_compact(F.array(
        v((kind == "sensitive_read") & (sub != "env") & ~F.col("sensitive_ok"), 1, "SENSITIVE_ACCESS", "CRITICAL",
          say(lit_("Script accesses sensitive path '"), d, lit_("' but NL step does not declare sensitive access")), reads_exp, say(lit_("Reads: "), d), sure["sensitive_read"]),
        v(is_read & dyn & ~open_read, 2, "SCOPE_EXCEED", "MEDIUM", lit_("Script reads files with dynamic path — cannot verify scope"),
          reads_exp, lit_("Dynamic file path"), sure["dynamic_read"]),
        v(is_read & ~dyn & secret & ~F.col("sensitive_ok"), 2, "SENSITIVE_ACCESS", "CRITICAL", say(lit_("Script reads sensitive path '"), d, lit_("'")),
          reads_exp, say(lit_("Reads: "), d), sure["sensitive_read"]),
        v(is_read & ~dyn & ~(secret & ~F.col("sensitive_ok")) & ~covered, 2, "SCOPE_EXCEED", "MEDIUM",
          say(lit_("Script reads '"), d, lit_("' outside declared scope")), reads_exp, say(lit_("Reads: "), d), sure["read_scope"]),
        v(is_net & ~F.col("network_ok"), 3, "UNDECLARED_SIDE_EFFECT", "HIGH",
          say(lit_("Script makes network request to '"), d, lit_("' but NL step does not declare network access")),
          lit_("No network access allowed"), say(lit_("Network request: "), d), sure["network"]),
        v(is_net & F.col("network_ok") & ~any_net & ~in_net, 3, "SCOPE_EXCEED", "HIGH",
          say(lit_("Script accesses '"), d, lit_("' but contract only allows "), q("allowed_network")),
          say(lit_("Allowed domains: "), q("allowed_network")), say(lit_("Accesses: "), d), sure["network_scope"]),
        v(is_proc & no_procs, 4, "UNDECLARED_SIDE_EFFECT", "MEDIUM", say(lit_("Script runs subprocess '"), d, lit_("' but no subprocess declared")),
          lit_("No subprocess allowed"), say(lit_("Subprocess: "), d), sure["process"]),
        v(is_proc & ~no_procs & ~F.array_contains("allowed_subprocesses", "*") & ~dyn & ~cmd_ok, 4, "SCOPE_EXCEED", "MEDIUM",
          say(lit_("Script runs '"), cmd, lit_("' but contract only allows "), q("allowed_subprocesses")),
          say(lit_("Allowed commands: "), q("allowed_subprocesses")), say(lit_("Runs: "), cmd), sure["process_scope"]),
        v((kind == "output") & (sub == "file_write") & secret, 5, "SENSITIVE_ACCESS", "CRITICAL", say(lit_("Script writes to sensitive path '"), d, lit_("'")),
          say(lit_("Allowed writes: "), q("allowed_file_writes")), say(lit_("Writes: "), d), sure["sensitive_write"])))
    per_act = acts.select("skill_id", "step_id", "step_index", "script", F.inline(checks))
    return per_act.unionByName(capability_inflation(bound, script_io, flags))


def capability_inflation(bound: DataFrame, script_io: DataFrame, flags: DataFrame) -> DataFrame:
    """Scripts with five or more capabilities behind a step of fewer than fifteen words."""
    counted = script_io.filter("kind in ('effect', 'sensitive_read')").groupBy("skill_id", "path").agg(F.count("*").alias("n"))
    caps = flags.join(counted, ["skill_id", "path"], "left").select(
        "skill_id", "path", (F.coalesce("n", F.lit(0)) + F.col("has_dynamic_execution").cast("int") + F.col("has_obfuscation").cast("int")).alias("n"))
    j = bound.join(caps.filter("n >= 5"), ["skill_id", "path"]).withColumn("w", F.size(c.words(F.col("description")))).filter("w < 15")
    return j.select(
        "skill_id", "step_id", "step_index", "script", F.lit(6).alias("check"), F.lit("CAPABILITY_INFLATION").alias("violation_type"), F.lit("MEDIUM").alias("severity"),
        F.format_string("Script has %d capabilities but NL description is only %d words", "n", "w").alias("violation"),
        F.lit("Capabilities proportional to NL description complexity").alias("expected"),
        F.format_string("%d capabilities for a %d-word description", "n", "w").alias("actual"), F.lit(fixed.VIOLATION_CONFIDENCE["inflation"]).alias("confidence"))


def phantom_scripts(scripts: DataFrame, summary: DataFrame, steps: DataFrame) -> DataFrame:
    """Scripts no step names or mentions, in packages whose steps name any script at all."""
    rows = scripts.select("skill_id", "path").withColumn("basename", c.basename(F.col("path"))).filter(~F.col("basename").isin(fixed.SAFE_SCRIPT_NAMES))
    unnamed = rows.join(script_links(steps).select("skill_id", "basename"), ["skill_id", "basename"], "left_anti")
    j = unnamed.join(summary.filter("has_link").select("skill_id", "steps_text"), "skill_id")
    return j.filter(~F.col("steps_text").contains(F.col("basename"))).select("skill_id", "path")


def enrich_findings(findings: DataFrame, steps: DataFrame, summary: DataFrame, contracts: DataFrame) -> DataFrame:
    """Re-weigh findings by what the package declares; the first rule that fits wins.

    Unreferenced script: up.  Covered by its step's contract: down.  Against the contract:
    up.  All else unchanged; the former severity, reason and action are kept.
    """
    links = script_links(steps).join(
        steps.select("skill_id", "step_index", "step_id", F.col("description").alias("step_text")), ["skill_id", "step_index"])
    known = links.join(contracts.select("skill_id", "step_id", "network_ok", "sensitive_ok", "allowed_subprocesses", "allowed_env_vars"),
                       ["skill_id", "step_id"], "left").drop("step_index")
    any_link = summary.select("skill_id", "has_link")
    j = (findings.withColumn("basename", c.basename(F.col("path")))
         .join(known, ["skill_id", "basename"], "left").join(any_link, "skill_id", "left"))
    cat, sev = F.col("category"), F.col("severity")
    has_step, has_contract = F.col("step_id").isNotNull(), F.col("network_ok").isNotNull()
    procs = F.coalesce("allowed_subprocesses", c.empty_strings())
    covered = (
        F.when(cat == "DataExfiltration", F.col("network_ok")).when(cat == "CredentialTheft", F.col("sensitive_ok"))
        .when(cat == "CommandInjection", F.exists(procs, lambda a: F.lower("evidence").contains(F.lower(a))))
        .when(cat == "Obfuscation", c.has_any(F.lower("step_text"), fixed.ENCODING_WORDS))
        .when(cat == "EnvHijacking", F.size(F.coalesce("allowed_env_vars", c.empty_strings())) > 0).otherwise(False))
    rank = c.severity_rank(sev)
    with_file = F.col("path") != ""
    action = (
        F.when(with_file & F.coalesce("has_link", F.lit(False)) & ~has_step & ~F.col("basename").isin(fixed.UPGRADE_EXEMPT_NAMES) & (rank >= 2), "phantom")
        .when(with_file & has_contract & cat.isin(fixed.COVERABLE_CATEGORIES) & covered, "covered")
        .when(with_file & has_contract & cat.isin(fixed.CONTRACT_CATEGORIES) & ~covered, "double"))
    j = j.withColumn("action", action)
    a = F.col("action")
    new = F.when(a == "covered", F.greatest(rank - 1, F.lit(0))).when(a.isNotNull(), F.least(rank + 1, F.lit(4))).otherwise(rank)
    reason = (
        F.when(a == "phantom", F.concat(F.lit("PHANTOM_SCRIPT: '"), "path", F.lit("' is not referenced in SKILL.md. Findings in unreferenced scripts are more suspicious.")))
        .when(a == "covered", F.concat(F.lit("NL_COVERED: NL step '"), "step_id", F.lit("' declares '"), F.substring("step_text", 1, 60), F.lit("' which covers this operation.")))
        .when(a == "double", F.concat(F.lit("DOUBLE_EVIDENCE: Code does '"), F.substring("description", 1, 50), F.lit("' which violates NL contract for step '"),
                                      "step_id", F.lit("' ("), F.substring("step_text", 1, 40), F.lit(")"))))
    return j.select(
        *[x for x in findings.columns if x != "severity"], c.severity_name(new).alias("severity"),
        F.when(a.isNotNull(), sev).alias("original_severity"), reason.alias("enrichment_reason"),
        F.when(a == "covered", "downgrade").when(a.isNotNull(), "upgrade").alias("enrichment_action"))


def enrichment_log(enriched: DataFrame) -> DataFrame:
    return enriched.filter("enrichment_action is not null").select(
        "skill_id", "path", "line", F.col("enrichment_action").alias("action"), F.col("enrichment_reason").alias("reason"),
        F.col("original_severity").alias("old_severity"), F.col("severity").alias("new_severity"))
