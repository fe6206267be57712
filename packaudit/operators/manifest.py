"""Front matter of instruction files: fields, permissions and their checks.

A manifest is one file of bounded size, so windows over its lines stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packaudit.functions import columns as c
from packaudit.functions import fixed, frontmatter
from packaudit.functions.lines import match_lines
from packaudit.functions.tables import findings
from packaudit.sources.packages import of_kind


def split_frontmatter(manifests: DataFrame) -> DataFrame:
    """Text between the leading marks and the body after them; no marks: all is body."""
    block = r"(?s)\A---(.*?)---(.*)\z"
    marked = F.col("content").rlike(block)
    return manifests.withColumns({
        "front": F.when(marked, F.regexp_extract("content", block, 1)),
        "body": F.when(marked, F.regexp_extract("content", block, 2)).otherwise(F.col("content")),
        "strict_front": c.first_match(F.col("content"), r"(?s)\A---\n(.*?)\n---"),
    })


def plain(value: Column) -> Column:
    """A scalar without quotes, trailing comment or surrounding blanks."""
    v = F.trim(F.regexp_replace(value, r"(^|\s)#.*$", ""))
    return F.regexp_replace(v, r"""^(["'])(.*)\1$""", "$2")


def front_lines(manifests: DataFrame) -> DataFrame:
    """Front-matter lines with the top-level and second-level key they stand under."""
    rows = split_frontmatter(manifests).filter("front is not null").select(
        "skill_id", F.posexplode(F.split("front", "\n")).alias("pos", "raw"))
    line = r"^\s*(?:-\s+)?([A-Za-z_][\w-]*)\s*:(?:\s+(.*))?\s*$"
    rows = rows.filter(~F.col("raw").rlike(r"^\s*(#.*)?$")).withColumns({
        "indent": F.length(F.regexp_extract("raw", r"^(\s*)", 1)),
        "item": F.when(F.col("raw").rlike(r"^\s*-\s+"), plain(F.regexp_extract("raw", r"^\s*-\s+(.*)$", 1))),
    })
    keyed = F.when(F.col("item").isNull(), c.first_match(F.col("raw"), line))
    rows = rows.withColumn("key", keyed).withColumn("value", plain(F.regexp_extract("raw", line, 2)))
    up = Window.partitionBy("skill_id").orderBy("pos")
    is_top = (F.col("indent") == 0) & F.col("key").isNotNull()
    rows = rows.withColumns({
        "top_key": F.last(F.when(is_top, F.col("key")), True).over(up),
        "top_pos": F.last(F.when(is_top, F.col("pos")), True).over(up),
    })
    under = Window.partitionBy("skill_id", "top_pos").orderBy("pos")
    inner = F.when(~is_top & F.col("key").isNotNull(), F.col("key"))
    return rows.withColumn("sub_key", F.last(inner, True).over(under))


def manifest_fields(manifests: DataFrame) -> DataFrame:
    """One row per package with a manifest: named fields, empty where absent."""
    lines = front_lines(manifests)
    is_top = F.col("indent") == 0

    def field(name: str) -> Column:
        return F.coalesce(F.max(F.when(is_top & (F.col("key") == name), F.col("value"))), F.lit(""))

    folded = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
        ~is_top & (F.col("top_key") == "description"), F.struct("pos", F.trim("raw").alias("t"))))), lambda x: x["t"]), " ")
    first_desc = F.min(F.when(F.trim("raw").startswith("description:"), F.struct(
        "pos", F.regexp_replace(F.trim(F.expr("substring(trim(raw), 13)")), r"^\"+|\"+$|^'+|'+$", "").alias("v"))))
    tag_items = F.transform(F.array_sort(F.collect_list(F.when(
        (F.col("top_key") == "tags") & F.col("item").isNotNull(), F.struct("pos", "item")))), lambda x: x["item"])
    short = F.max(F.when((F.col("top_key") == "metadata") & (F.col("key") == "short-description"), F.col("value")))
    agg = lines.groupBy("skill_id").agg(
        F.bool_or(is_top & F.col("key").isNotNull()).alias("has_frontmatter"),
        field("name").alias("name"), field("version").alias("version"), field("author").alias("author"),
        field("description").alias("d"), folded.alias("folded"), short.alias("short"),
        F.bool_or(is_top & (F.col("key") == "description")).alias("has_description"),
        first_desc["v"].alias("purpose"), field("tags").alias("t"), tag_items.alias("tag_items"))
    block = F.col("d").isin("", ">", "|", ">-", "|-", ">+", "|+")
    description = F.when(F.col("has_description"), F.when(block, F.col("folded")).otherwise(
        F.trim(F.concat_ws(" ", "d", "folded")))).otherwise(F.coalesce("short", F.lit("")))
    tags = F.when(F.size("tag_items") > 0, F.col("tag_items")).when(F.col("t") == "", c.empty_strings()).otherwise(
        F.transform(F.split(F.regexp_replace("t", r"^\[|\]$", ""), ","), lambda v: plain(v)))
    fields = agg.select("skill_id", "has_frontmatter", "name", description.alias("description"), "version",
                        "author", tags.alias("tags"), "purpose")
    base = split_frontmatter(manifests).select("skill_id", "path", "front", "strict_front", "body")
    out = base.join(fields, "skill_id", "left")
    return out.withColumns({
        **{k: F.coalesce(F.col(k), F.lit("")) for k in ("name", "description", "version", "author", "purpose")},
        "has_frontmatter": F.coalesce("has_frontmatter", F.lit(False)),
        "tags": F.coalesce("tags", c.empty_strings()),
    })


def front_paths(manifests: DataFrame) -> DataFrame:
    """(skill_id, pos, keys, value) per scalar of the front matter, to any depth.

    A file without front matter has no rows.  One Arrow pass over the headers alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]
        for batch in batches:
            rows = [(skill, *row) for skill, front in zip(batch.column("skill_id").to_pylist(), batch.column("front").to_pylist()) for row in frontmatter.paths(front)]
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds)], ["skill_id", "pos", "keys", "value"])

    fronts = split_frontmatter(manifests).filter("front is not null").select("skill_id", "front")
    return fronts.mapInArrow(run, "skill_id string, pos int, keys array<string>, value string")


def permissions(manifests: DataFrame) -> DataFrame:
    """Declared permissions as (package, type, scope) rows; whatever stands below a type, at any
    depth, is a scope of it."""
    under = front_paths(manifests).filter((F.get("keys", F.lit(0)) == "permissions") & (F.size("keys") > 1))
    return under.select("skill_id", "pos", F.get("keys", F.lit(1)).alias("perm_type"), F.col("value").alias("scope"))


def dangerous_permissions(perms: DataFrame) -> DataFrame:
    hit = F.lit(None).cast("string")
    for perm, pattern, severity in fixed.DANGEROUS_PERMISSIONS:
        hit = F.when((F.col("perm_type") == perm) & c.matches(F.col("scope"), pattern), severity).otherwise(hit)
    hits = perms.withColumn("severity", hit).filter("severity is not null")
    return findings(
        hits, "manifest", F.col("severity"), "CapabilityInflation",
        F.concat(F.lit("Broad permission declared: "), "perm_type", F.lit("="), "scope"), path="SKILL.md",
        evidence=F.concat("perm_type", F.lit(": "), "scope"), pos=F.col("pos"))


def validate_manifest(manifests: DataFrame, fields: DataFrame, perms: DataFrame, files: DataFrame) -> DataFrame:
    """Findings about missing or vague fields, broad permissions and unsafe type tags."""
    has_scripts = files.filter(F.col("path").startswith("scripts/")).select("skill_id").distinct().withColumn("scripts", F.lit(True))
    has_perms = perms.select("skill_id").distinct().withColumn("perms", F.lit(True))
    rows = fields.join(has_scripts, "skill_id", "left").join(has_perms, "skill_id", "left")
    ok = F.col("has_frontmatter")

    def note(test: Column, severity: str, category: str, text: str, evidence=None) -> Column:
        return F.when(test, F.struct(
            F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(text).alias("text"),
            (F.lit("") if evidence is None else evidence).alias("evidence")))

    checks = F.array(
        note(~ok, "LOW", "Unknown", "SKILL.md has no valid YAML frontmatter"),
        note(ok & (F.col("name") == ""), "LOW", "Unknown", "Manifest missing 'name' field"),
        note(ok & (F.col("description") == ""), "MEDIUM", "SemanticCamouflage",
             "Manifest missing 'description' field — vague skills are harder to audit"),
        note(ok & F.length("description").between(1, 9), "LOW", "SemanticCamouflage",
             "Manifest description is very short — may indicate evasion"),
        note(ok & F.col("perms").isNull() & F.col("scripts").isNotNull(), "LOW", "Unknown",
             "Skill has scripts but no permissions declared in manifest"),
        note(ok & c.has_any(F.coalesce("front", F.lit("")), ["!!python", "!!ruby"]), "CRITICAL", "RemoteCodeExecution",
             "YAML deserialization attack: unsafe type tag in frontmatter", F.substring("front", 1, 200)),
    )
    hits = rows.select("skill_id", F.posexplode(F.array_compact(checks)).alias("pos", "n"))
    own = findings(hits, "manifest", F.col("n.severity"), F.col("n.category"), F.col("n.text"), path="SKILL.md",
                   evidence=F.col("n.evidence"), pos=F.col("pos"))
    return own.unionByName(dangerous_permissions(perms))


def permission_text(perms: DataFrame) -> DataFrame:
    """All permissions of a package as one short text; a manifest bounds their number."""
    per = perms.groupBy("skill_id", "perm_type").agg(
        F.min("pos").alias("p"), F.array_sort(F.collect_list(F.struct("pos", "scope"))).alias("s"))
    entry = F.concat(F.lit("'"), F.col("perm_type"), F.lit("': ["), F.array_join(
        F.transform("s", lambda x: F.concat(F.lit("'"), x["scope"], F.lit("'"))), ", "), F.lit("]"))
    return per.groupBy("skill_id").agg(F.concat(F.lit("{"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("p", entry.alias("e")))), lambda x: x["e"]), ", "), F.lit("}")).alias("perm_text"))


def audit_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Check: required manifest fields and over-broad permissions."""
    rows = tables["manifest"].filter("path = 'SKILL.md'").join(permission_text(tables["permissions"]), "skill_id", "left")
    absent = F.col("strict_front").isNull()
    text = F.coalesce("perm_text", F.lit(""))
    marks = [F.when(absent, F.struct(F.lit("LOW").alias("s"), F.lit("Unknown").alias("c"), F.lit(
        "SKILL.md missing YAML frontmatter (permissions undeclared)").alias("t")))]
    for name in ("name", "description", "version"):
        marks.append(F.when(~absent & (F.col(name) == ""), F.struct(
            F.lit("LOW").alias("s"), F.lit("Unknown").alias("c"),
            F.lit(f"Frontmatter missing required field: '{name}'").alias("t"))))
    for label, pattern in fixed.BROAD_PERMISSIONS:
        marks.append(F.when(~absent & c.matches(text, pattern), F.struct(
            F.lit("MEDIUM").alias("s"), F.lit("T11-CapabilityExpansion").alias("c"),
            F.concat(F.lit(f"Manifest declares overly broad permission ({label}): "), F.substring(text, 1, 80)).alias("t"))))
    hits = rows.select("skill_id", F.posexplode(F.array_compact(F.array(*marks))).alias("pos", "m"))
    return findings(hits, "manifest_audit", F.col("m.s"), F.col("m.c"), F.col("m.t"), path="SKILL.md", pos=F.col("pos"))


def audit_embedded(tables: dict[str, DataFrame]) -> DataFrame:
    """Check: long quoted base64 blobs and hard-coded addresses."""
    text = of_kind(tables["files"], "py", "doc").filter("not is_binary and content is not null").filter(F.col("ext").isin(".py", ".md"))
    at = ["skill_id", "path", "basename"]
    # What any match must hold is tested first: a text that long, and the mark of an address.
    blobs = match_lines(text.filter(F.length("content") >= 82), at, fixed.QUOTED_BLOB, name="blob").withColumn("packed", F.regexp_replace("blob", "[\n ]", ""))
    blobs = blobs.filter((F.length("blob") >= 80) & (F.length("packed") >= 80) & (F.length("packed") % 4 == 0)
                         & F.call_function("try_to_binary", "packed", F.lit("base64")).isNotNull())
    blobs = blobs.withColumn("bits", c.entropy(F.col("packed"))).filter("bits > 4.8")
    b = findings(blobs, "embedded_resource", "HIGH", "T5-RemoteCodeExecution",
                 F.concat(F.format_string("Embedded high-entropy base64 blob (%d chars, entropy≈%.1f) in ",
                                          F.length("blob"), F.col("bits")), "basename"),
                 path=F.col("path"), line=F.col("line"), pos=F.col("pos"))
    urls = match_lines(text.filter(F.col("content").contains("://")), at, "(?i)" + fixed.UNLISTED_URL, name="url")
    u = findings(urls, "embedded_resource", "MEDIUM", "T3-DataExfiltration",
                 F.concat(F.lit("Suspicious hardcoded external URL: "), F.substring("url", 1, 80), F.lit(" in "), "basename"),
                 path=F.col("path"), line=F.col("line"), pos=F.col("pos") + 100000)
    return b.unionByName(u)


def audit_comments(tables: dict[str, DataFrame]) -> DataFrame:
    """Check: instruction-like comments in Python files."""
    py = of_kind(tables["files"], "py").filter("ext = '.py' and not is_binary and content is not null")
    hot = py.filter(c.matches(F.col("content"), fixed.COMMENT_INJECTION))
    lines = hot.select("skill_id", "path", F.posexplode(F.split("content", "\r\n|\r|\n")).alias("pos", "text"))
    hits = lines.filter(c.matches(F.col("text"), fixed.COMMENT_INJECTION))
    return findings(hits, "comment_injection", "HIGH", "T10-InstructionMisdirection",
                   F.concat(F.lit("Potential hidden instruction in code comment: "), F.substring(F.trim("text"), 1, 80)),
                   path=F.col("path"), line=F.col("pos") + 1, pos=F.col("pos"))
