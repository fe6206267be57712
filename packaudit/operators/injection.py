"""Instruction-injection detection: tiered rules with hidden text, and weighted rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit.functions import anchors as anc
from packaudit.functions import columns as c
from packaudit.functions import fixed
from packaudit.functions.tables import findings, first_rows


def tier_rules() -> list[tuple[str, str, str]]:
    return ([("tier1", n, p) for n, p in fixed.TIER1] + [("tier2", n, p) for n, p in fixed.TIER2])


def tier_hits(df: DataFrame, rules: list[tuple[str, str, str]], text: str = "content",
              anchors: dict[str, list[str]] = anc.TIERS, snippets: dict[str, int] | None = None) -> DataFrame:
    """One row per text and matching rule: tier, name and what matched, in order.

    ``snippets`` keeps only the first ones of a tier, as a report shows them.
    """
    t = F.col(text)

    def marks(may) -> Column:
        out = []
        for i, (tier, name, pattern) in enumerate(rules):
            matched = c.all_matches(t, c.rx(f"({pattern})", dotall=True))
            shown = F.slice(matched, 1, snippets[tier]) if snippets and tier in snippets else matched
            out.append(F.when(
                may(anchors.get(name)) & c.matches(t, pattern, dotall=True),
                F.struct(F.lit(i).alias("rule_pos"), F.lit(tier).alias("tier"), F.lit(name).alias("name"),
                         F.transform(shown, lambda m: F.substring(m, 1, 100)).alias("snippets"))))
        return F.array_compact(F.array(*out))

    return df.select(*[x for x in df.columns if x != text], F.inline(anc.guarded(t, marks)))


def encoded_hits(df: DataFrame, text: str = "content") -> DataFrame:
    """Hex and Unicode escape runs, and two HTML entities with a telling word after them.

    The last rule is tested in two steps, entities first and words in the rest: the same
    matches in one walk over the text, where its single pattern would walk it again and again.
    """
    t = F.col(text)
    entity, telling = fixed.HTML_ENTITY, fixed.HTML_WORDS
    rest = c.first_match(t, f"(?s){entity}.*?{entity}(.*)\\z")
    tests = {name: t.rlike(p) for name, p in fixed.ENCODED_RUNS if name != "html_encoded_inject"}
    tests["html_encoded_inject"] = F.coalesce(has_any_folded(rest, telling), F.lit(False))
    marks = [F.when(test, F.struct(F.lit("encoding").alias("tier"), F.lit(name).alias("name"))) for name, test in tests.items()]
    return df.select("skill_id", F.inline(F.array_compact(F.array(*marks))))


def has_any_folded(text: Column, words: list[str]) -> Column:
    return anc.guarded(text, lambda may: may(words))


def base64_runs(df: DataFrame, pattern: str = fixed.BASE64_RUN, limit: int | None = None,
                order: tuple[str, ...] = ("file_order", "path"), text: str = "content") -> DataFrame:
    """Base64 runs of each package; with ``limit`` only the first ones in reading order."""
    runs = df.select("skill_id", *order, F.posexplode(c.all_matches(F.col(text), f"({pattern})")).alias("pos", "run"))
    return first_rows(runs, ["skill_id"], [F.col(x) for x in (*order, "pos")], limit)


def base64_hits(df: DataFrame) -> DataFrame:
    """Injection rules that match inside decoded base64 runs; first rule per run wins."""
    runs = base64_runs(df).withColumn("decoded", c.decode_base64(F.col("run")))
    legible = runs.filter((F.length("decoded") > 20) & (c.printable_share(F.col("decoded")) > 0.7))
    name = F.coalesce(*[
        F.when(c.matches(F.col("decoded"), p, dotall=True), F.lit(n)) for _, n, p in tier_rules()])
    hit = legible.withColumn("rule", name).filter("rule is not null")
    tier = F.when(F.col("rule").isin(fixed.ESCALATED_HITS), "tier1").otherwise("encoding")
    return hit.select("skill_id", tier.alias("tier"), F.concat(F.lit("base64_decoded:"), "rule").alias("name"))


def invisible_hits(df: DataFrame, more_than: int = 2) -> DataFrame:
    per = df.groupBy("skill_id").agg(
        F.sum(F.regexp_count("content", F.lit(fixed.INVISIBLE_CHARS))).alias("n"))
    return per.filter(F.col("n") > more_than).select(
        "skill_id", F.lit("steganography").alias("tier"),
        F.concat(F.lit("invisible_chars:count="), F.col("n")).alias("name"))


def flood_hits(df: DataFrame, line_length: int = 200, lines_over: int = 20, min_chars: int = 5000,
               share: float = 0.15, key: str = "skill_id", text: str = "content") -> DataFrame:
    """Texts built to fill a context window: very many long lines, or one word again and again.

    Words are counted per key and word first, so the hot key's words spread over all tasks.
    """
    t = F.col(text)
    per = df.select(
        key, F.length(t).alias("chars"),
        F.size(F.filter(F.split(t, "\n"), lambda l: F.length(l) > line_length)).alias("long"))
    # files are joined by a blank line when read as one text: two more characters each
    size = per.groupBy(key).agg(
        (F.sum("chars") + 2 * (F.count("*") - 1)).alias("chars"), F.sum("long").alias("long"))
    long_lines = size.filter(F.col("long") > lines_over).select(
        key, F.lit("dos").alias("tier"), F.concat(F.lit("context_bomb:long_lines="), F.col("long")).alias("name"))
    big = df.join(size.filter(F.col("chars") > min_chars).select(key), key, "left_semi")
    counts = (big.select(key, F.explode(c.words(F.lower(t))).alias("word"))
              .groupBy(key, "word").agg(F.count("*").alias("n")))
    top = counts.groupBy(key).agg(
        F.sum("n").alias("total"), F.max(F.struct(F.col("n"), F.col("word"))).alias("top"))
    repeated = top.withColumn("share", F.col("top.n") / F.col("total")).filter(F.col("share") > share).select(
        key, F.lit("dos").alias("tier"),
        F.concat(F.lit("context_bomb:word_repetition="), F.col("top.word"), F.lit(":"),
                 F.format_string("%.2f", F.bround("share", 2))).alias("name"))
    return long_lines.unionByName(repeated)


def tiered_confidence(hits: DataFrame) -> DataFrame:
    """Hits (skill_id, tier, name) to one confidence per package."""

    def n(*tiers: str) -> Column:
        return F.count_if(F.col("tier").isin(*tiers)).cast("double")

    per = hits.groupBy("skill_id").agg(
        n("tier1").alias("tier1"), n("tier2").alias("tier2"), n("encoding", "steganography").alias("hidden"))
    one = F.lit(1.0)
    base = F.least(
        one,
        0.7 * F.least(one, F.col("tier1") * 0.6) + 0.2 * F.least(one, F.col("tier2") * 0.4)
        + 0.1 * F.least(one, F.col("hidden") * 0.5))
    conf = F.when(F.col("tier1") >= 2, F.greatest(base, F.lit(0.9))).otherwise(base)
    return per.select("skill_id", "tier1", "tier2", "hidden", conf.alias("confidence"),
                      (conf > 0.4).alias("is_injection"))


def detect_tiered(texts: DataFrame) -> DataFrame:
    """All detections over the top-level texts of each package (see ``injection_files``).

    A rule counts once per package however many of its files match.
    """
    named = tier_hits(texts.select("skill_id", "content"), tier_rules()).select("skill_id", "tier", "name").distinct()
    foreign = texts.filter(c.matches(F.col("content"), fixed.OTHER_LANGUAGES)).select(
        "skill_id", F.lit("tier1").alias("tier"), F.lit("multilang_injection").alias("name")).distinct()
    return (named.unionByName(encoded_hits(texts).distinct()).unionByName(base64_hits(texts))
            .unionByName(invisible_hits(texts)).unionByName(foreign).unionByName(flood_hits(texts)))


def injection_finding(hits: DataFrame) -> DataFrame:
    """The single finding a flagged package gets, ahead of its code findings.

    Distinct detections are as many as there are rules and counters, so the first three can
    be picked from a short list.
    """
    ladder = ["tier1", "tier2", "encoding", "steganography", "dos"]
    shown = hits.groupBy("skill_id", "tier", "name").count().groupBy("skill_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct(
            c.ranked(F.col("tier"), ladder).alias("o"), F.concat_ws("/", "tier", "name").alias("t")))), 1, 3).alias("s"))
    flagged = tiered_confidence(hits).filter("is_injection").join(shown, "skill_id")
    names = F.concat_ws("; ", F.transform("s", lambda x: x["t"]))
    return findings(
        flagged, "injection", F.when(F.col("confidence") > 0.7, "CRITICAL").otherwise("HIGH"), "PromptInjection",
        F.concat(F.format_string("Prompt injection detected in SKILL.md (confidence=%.2f): ", F.col("confidence")), names),
        path="SKILL.md", evidence=names, confidence=F.col("confidence"), pos=-1)


def weighted_hits(df: DataFrame, rules: list[tuple[str, float, str]] = fixed.WEIGHTED_INJECTION,
                  text: str = "content", anchors: dict[str, list[str]] = anc.WEIGHTED) -> DataFrame:
    """One row per text and matching weighted rule, with the first matching snippet."""
    t = F.col(text)

    def marks(may) -> Column:
        out = []
        for i, (name, weight, pattern) in enumerate(rules):
            first = F.substring(F.regexp_extract(t, c.rx(f"({pattern})"), 1), 1, 80)
            out.append(F.when(may(anchors.get(name)) & c.matches(t, pattern), F.struct(
                F.lit(i).alias("rule_pos"), F.lit(name).alias("name"), F.lit(weight).alias("weight"),
                F.replace(first, F.lit("\n"), F.lit(" ")).alias("snippet"))))
        return F.array_compact(F.array(*out))

    return df.select(*[x for x in df.columns if x != text], F.inline(anc.guarded(t, marks)))


def weighted_confidence(hits: DataFrame, key: str = "skill_id") -> DataFrame:
    """Strongest rule plus a bonus for each further distinct rule."""
    per = hits.groupBy(key, "name").agg(F.max("weight").alias("weight")).groupBy(key).agg(
        F.max("weight").alias("top"), F.count("*").alias("distinct_rules"))
    conf = F.when(F.col("distinct_rules") > 1,
                  F.least(F.lit(1.0), F.col("top") + 0.10 * (F.col("distinct_rules") - 1))).otherwise(F.col("top"))
    return per.select(key, "distinct_rules", conf.alias("confidence"),
                      (conf >= fixed.WEIGHTED_THRESHOLD).alias("detected"))


def probe_hits(files: DataFrame) -> DataFrame:
    """Packages whose instruction text or any of whose scripts holds the wrapper mark."""
    marked = c.has_any(F.col("content"), fixed.PROBE_MARKERS)
    doc = files.filter((F.col("path") == "SKILL.md") & marked).select("skill_id")
    scripts = files.filter(F.col("path").rlike(r"^(scripts/)?[^/]+\.py$")).select(
        "skill_id", "path", marked.alias("marked"))
    return doc.unionByName(scripts.filter("marked").select("skill_id")).distinct()
