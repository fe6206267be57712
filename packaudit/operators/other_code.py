"""Shell, JavaScript and YAML files: inputs, effects, flags and findings by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit.functions import columns as c
from packaudit.functions import fixed, lines
from packaudit.functions.tables import findings


def shell_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("ext").isin(fixed.SHELL_EXTENSIONS))


def js_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("ext").isin(fixed.JS_EXTENSIONS))


def yaml_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("ext").isin(".yaml", ".yml"))


FACT = "array<struct<kind:string,subtype:string,detail:string,line:int,pos:int>>"
NOTE = "array<struct<severity:string,category:string,text:string,evidence:string,confidence:double,pos:int>>"


def _one(test: Column, *values) -> Column:
    """A list with one entry where ``test`` holds, else an empty one."""
    return F.array_compact(F.array(F.when(test, F.struct(*[v if isinstance(v, Column) else F.lit(v) for v in values]))))


def _each(pattern: str, entry, keep=None, group: int = 1) -> Column:
    """A list with one entry per match; ``entry`` gets the match and its position."""
    found = c.all_matches(F.col("content"), pattern, group)
    pairs = F.transform(found, lambda m, i: F.struct(m.alias("m"), i.alias("i")))
    if keep is not None:
        pairs = F.filter(pairs, lambda p: keep(p["m"]))
    return F.transform(pairs, lambda p: F.struct(*[v if isinstance(v, Column) else F.lit(v) for v in entry(p["m"], p["i"])]))


def _rows(df: DataFrame, kind: str, lists: list[Column]) -> DataFrame:
    every = F.flatten(F.array(*[x.cast(kind) for x in lists]))
    return df.select("skill_id", "path", F.inline(every))


def shell_io(files: DataFrame) -> DataFrame:
    """Facts of shell scripts, in one pass over each file."""
    t = F.col("content")
    url = lambda m: F.regexp_extract(m, r"(https?://\S+)$", 1)
    return _rows(shell_files(files), FACT, [
        _one(c.has_any(t, ["$1", "$@", "$*"]), "input", "argv", "shell args", 0, 0),
        _one(c.has_any(t, ["read ", "/dev/stdin"]), "input", "stdin", "", 0, 0),
        _each(fixed.SHELL_FETCH, lambda m, i: ("effect", "network_request", url(m), 0, i)),
        _each(fixed.SHELL_FETCH, lambda m, i: ("output", "network_post", url(m), 0, i), lambda m: c.has_any(m, ["-d", "--data", "-X POST"])),
        _each(c.rx(f"({fixed.SENSITIVE_PATH_A})"), lambda m, i: ("sensitive_read", "path", m, 0, i)),
    ])


def js_io(files: DataFrame) -> DataFrame:
    """Facts of JavaScript and TypeScript files, in one pass over each file.

    The line of a process call is summed up afterwards, over the calls of its file.
    """
    t = F.col("content")
    calls = F.when(c.matches(t, fixed.JS_PROCESS), F.transform(lines.found(t, "(?i)" + fixed.JS_PROCESS, 0), lambda m, i: F.struct(
        F.lit("effect"), F.lit("subprocess"), F.lit("child_process"), m["before"], i, m["inside"])))
    plain = [
        _each("(?i)" + fixed.JS_NETWORK, lambda m, i: ("effect", "network_request", m, 0, i, None)),
        _each(fixed.JS_ENV, lambda m, i: ("input", "env_var", m, 0, i, None)),
        _each(fixed.JS_ENV, lambda m, i: ("sensitive_read", "env", F.concat(F.lit("env:"), m), 0, i, None), c.is_secret_env),
        _each(fixed.JS_READ, lambda m, i: ("sensitive_read", "path", m, 0, i, None), c.is_sensitive_a),
    ]
    kind = FACT.replace("pos:int", "pos:int,inside:int")
    rows = _rows(js_files(files), kind, [*plain, F.coalesce(calls.cast(kind), F.array().cast(kind))])
    counted = lines.with_lines(rows.withColumn("is_call", F.col("inside").isNotNull()), ["skill_id", "path", "is_call"], before="line")
    return counted.select("skill_id", "path", "kind", "subtype", "detail", F.when(F.col("is_call"), F.col("line")).otherwise(0).alias("line"), "pos")


def other_findings(files: DataFrame) -> DataFrame:
    """Findings of shell, JavaScript and YAML files, in one pass over each file."""
    t = F.col("content")
    known = lambda m: c.matches(m, fixed.EXFIL_ENDPOINT)
    said = lambda text, m: F.concat(F.lit(text), F.substring(m, 1, 80))
    none = F.array().cast(NOTE)
    sh = _one(t.rlike(fixed.SHELL_PIPE), "CRITICAL", "SupplyChainPoisoning", "Shell script pipes remote content to interpreter (curl|bash)", "", 0.95, 0)
    net = "(?i)" + fixed.JS_NETWORK
    js = F.flatten(F.array(*[x.cast(NOTE) for x in (
        _each(net, lambda m, i: ("MEDIUM", "DataExfiltration", said("External network call in JS/TS: ", m), F.substring(m, 1, 100), 1.0, i), lambda m: c.is_external_a(m) & ~known(m)),
        _each(net, lambda m, i: ("CRITICAL", "DataExfiltration", said("Known exfiltration endpoint in JS/TS: ", m), F.substring(m, 1, 100), 1.0, i), known),
        _one(t.rlike(fixed.JS_DYNAMIC), "HIGH", "RemoteCodeExecution", "Dynamic code execution in JS/TS: eval() or new Function()", "", 1.0, 0),
        _each(fixed.JS_READ, lambda m, i: ("CRITICAL", "CredentialTheft", F.concat(F.lit("Sensitive file access in JS/TS: "), m), m, 1.0, i), c.is_sensitive_a))]))
    wide = t.rlike("(?i)" + fixed.YAML_PERMISSION) & t.rlike(fixed.YAML_WILDCARD)
    ya = F.flatten(F.array(*[x.cast(NOTE) for x in (
        _one(wide, "HIGH", "CapabilityInflation", "YAML manifest declares wildcard/all permissions", "", 0.8, 0),
        _each(c.rx(f"({fixed.EXTERNAL_URL_A})"), lambda m, i: ("CRITICAL", "DataExfiltration", said("Known exfiltration endpoint in YAML: ", m), F.substring(m, 1, 100), 1.0, i), known))]))
    ext = F.col("ext")
    rows = files.filter(ext.isin(fixed.SHELL_EXTENSIONS + fixed.JS_EXTENSIONS + [".yaml", ".yml"])).select(
        "skill_id", "path", F.inline(F.when(ext.isin(fixed.SHELL_EXTENSIONS), sh.cast(NOTE)).when(ext.isin(fixed.JS_EXTENSIONS), js).when(ext.isin(".yaml", ".yml"), ya).otherwise(none)))
    return findings(rows, "code", F.col("severity"), F.col("category"), F.col("text"), path=F.col("path"), evidence=F.col("evidence"), confidence=F.col("confidence"), pos=F.col("pos"))


def other_flags(files: DataFrame) -> DataFrame:
    """Flag rows for every shell, JavaScript and YAML file."""
    sh = F.col("ext").isin(fixed.SHELL_EXTENSIONS) & F.col("content").rlike(fixed.SHELL_PIPE)
    js = F.col("ext").isin(fixed.JS_EXTENSIONS) & F.col("content").rlike(fixed.JS_DYNAMIC)
    rows = files.filter(F.col("ext").isin(fixed.SHELL_EXTENSIONS + fixed.JS_EXTENSIONS + [".yaml", ".yml"]))
    return rows.select("skill_id", "path", F.when(sh | js, 0.3).otherwise(1.0).alias("analyzability"), F.lit(False).alias("has_obfuscation"),
                       (sh | js).alias("has_dynamic_execution"), F.lit(False).alias("has_encoded_payloads"), F.lit(False).alias("entry_point"))


def is_script() -> Column:
    """Files that count as scripts of a package."""
    return F.col("ext").isin([".py"] + fixed.SHELL_EXTENSIONS + fixed.JS_EXTENSIONS)
