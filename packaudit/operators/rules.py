"""Rules as data, compiled to literal expressions: line scans and literal scans."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit.functions import anchors as anc
from packaudit.functions import columns as c
from packaudit.functions import fixed
from packaudit.functions.tables import findings


@dataclass(frozen=True)
class Rule:
    """One named pattern.  ``skip`` lists file types (``doc``, ``py``) it does not apply to.

    Every match must contain one of ``anchors``, if there are any (see ``anchors``).
    """

    name: str
    pattern: str
    severity: str
    category: str
    skip: tuple[str, ...] = ()
    in_comments: bool = False
    anchors: tuple[str, ...] = ()

    def hits(self, text: Column) -> Column:
        return c.matches(text, self.pattern)


def line_rules() -> list[Rule]:
    out = []
    for name, pattern, severity, category in fixed.LINE_RULES:
        skip = tuple(
            kind for kind, cats in (("doc", fixed.DOC_SKIP_CATEGORIES), ("py", fixed.PY_SKIP_CATEGORIES))
            if category in cats)
        out.append(Rule(name, pattern, severity, category, skip, category == "PromptInjection", tuple(anc.LINE[name])))
    return out


def file_kind(ext: Column) -> Column:
    return F.when(ext.isin(fixed.DOC_EXTENSIONS), "doc").when(ext == ".py", "py").otherwise("other")


def applies(rule: Rule, ext: Column) -> Column:
    if not rule.skip:
        return F.lit(True)
    return ~file_kind(ext).isin(*rule.skip)


def explode_lines(files: DataFrame, keep: Column | None = None) -> DataFrame:
    """Numbered lines of every file, or only of files for which ``keep`` holds.

    The test is part of the generator, so it runs where the file is and is made once.
    """
    lines = F.split("content", "\n")
    if keep is not None:
        lines = F.when(keep, lines)
    return files.select("skill_id", "path", "ext", F.posexplode(lines).alias("pos", "text")).withColumn("line", F.col("pos") + 1).drop("pos")


def scan_lines(files: DataFrame, rules: list[Rule], exclude_comments: bool = True) -> DataFrame:
    """Rule hits per line.

    A file in which no rule matches anywhere cannot have a matching line, so whole files
    are tested first and only those with a hit are exploded into lines.
    """
    def in_file(may) -> Column:
        tests = [applies(r, F.col("ext")) & may(r.anchors) & r.hits(F.col("content")) for r in rules]
        return reduce(lambda a, b: a | b, tests)

    lines = explode_lines(files, anc.guarded(F.col("content"), in_file))
    stripped = F.trim(F.col("text"), F.lit(" \t\r\n\f\u000b"))

    def in_line(may) -> Column:
        marks = []
        for i, r in enumerate(rules):
            ok = applies(r, F.col("ext")) & may(r.anchors) & r.hits(F.col("text"))
            if exclude_comments and not r.in_comments:
                ok = ok & ~stripped.startswith("#")
            marks.append(F.when(ok, F.struct(
                F.lit(i).alias("rule_pos"), F.lit(r.name).alias("rule"),
                F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"))))
        return F.array_compact(F.array(*marks))

    hits = lines.select("*", F.inline(anc.guarded(F.col("text"), in_line)))
    return hits.withColumn("stripped", stripped)


def line_findings(files: DataFrame) -> DataFrame:
    """The seven line rules over all text files, as findings."""
    hits = scan_lines(files, line_rules())
    return findings(
        hits, "pattern", F.col("severity"), F.col("category"),
        F.concat(F.col("rule"), F.lit(": "), F.substring("stripped", 1, 100)),
        path=F.col("path"), line=F.col("line"), evidence=F.substring("stripped", 1, 120),
        pos=F.col("line") * 10 + F.col("rule_pos"))


def literal_findings(literals: DataFrame) -> DataFrame:
    """Known exfiltration endpoints and high-entropy text among string constants."""
    value = F.col("value")
    exfil = c.is_external_a(value) & c.matches(value, fixed.EXFIL_ENDPOINT)
    ends = findings(
        literals.filter(exfil), "literal", "CRITICAL", "DataExfiltration",
        F.concat(F.lit("Known exfiltration endpoint: "), F.substring(value, 1, 80)),
        path=F.col("path"), line=F.col("line"), evidence=F.substring(value, 1, 120), pos=F.col("pos"))
    dense = high_entropy(literals)
    packed = findings(
        dense, "literal", "MEDIUM", "Obfuscation",
        F.format_string("High-entropy string (entropy=%.1f, len=%d): potential encoded payload",
                        F.col("bits"), F.length(value)),
        path=F.col("path"), line=F.col("line"), evidence=F.substring(value, 1, 60), pos=F.col("pos"))
    return ends.unionByName(packed)


def high_entropy(literals: DataFrame, min_bits: float = 5.0, longer_than: int = 64) -> DataFrame:
    """String constants that look like packed data; length is tested before the costly part."""
    return (literals.filter(F.length("value") > longer_than)
            .withColumn("bits", c.entropy(F.col("value"))).filter(F.col("bits") > min_bits))


def is_packed(value: Column, min_bits: float = 5.0, longer_than: int = 64) -> Column:
    """The test of ``high_entropy`` as a column."""
    return F.when(F.length(value) > longer_than, c.entropy(value) > min_bits).otherwise(False)


def sensitive_literals(literals: DataFrame) -> DataFrame:
    """String constants that name a sensitive path; bare short names do not count."""
    v = F.col("value")
    bare = (
        (F.length(v) <= 10) & ~v.contains("/") & ~v.contains("\\") & ~v.startswith("~") & ~v.startswith("$")
    )
    return literals.filter(c.is_sensitive_a(v) & ~bare)


def drop_duplicate_hits(hits: DataFrame, op_findings: DataFrame) -> DataFrame:
    """Pattern hits whose evidence an operation finding of the same file already carries."""
    known = op_findings.filter("evidence <> ''").select("skill_id", "path", "evidence").distinct()
    return hits.join(known, ["skill_id", "path", "evidence"], "left_anti")
