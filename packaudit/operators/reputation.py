"""External addresses of packages, matched with a supplied reputation table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.functions import columns as c
from packaudit.functions import fixed
from packaudit.functions.tables import findings, first_rows


def external_urls(script_io: DataFrame) -> DataFrame:
    """Distinct external addresses that network effects name, each at its first place."""
    net = script_io.filter("kind = 'effect' and subtype = 'network_request' and detail not in ('', '<dynamic>')")
    return distinct_urls(net.filter(c.is_external_a(F.col("detail"))).select("skill_id", "path", "pos", F.col("detail").alias("url")))


def distinct_urls(rows: DataFrame) -> DataFrame:
    return rows.groupBy("skill_id", "url").agg(F.min(F.struct("path", "pos")).alias("first"))


def urls_to_check(urls: DataFrame, max_urls: int | None = None) -> DataFrame:
    """Addresses of each package that are not well-known infrastructure; with ``max_urls``,
    for a look-up service with a quota, only the first ones."""
    return first_rows(urls.filter(~c.is_trusted_url(F.col("url"))), ["skill_id"], [F.col("first"), F.col("url")], max_urls)


def reputation_findings(candidates: DataFrame, reputation: DataFrame) -> DataFrame:
    """Findings for addresses known as malicious or suspicious.  Spark picks the join by size."""
    j = candidates.join(reputation, "url")
    bad = F.col("malicious") > 0
    odd = ~bad & (F.col("suspicious") > 0)
    rest = F.col("harmless") + F.col("undetected")
    conf = F.when(bad, F.col("malicious") / F.greatest(F.col("malicious") + rest, F.lit(5))).otherwise(
        F.col("suspicious") / F.greatest(F.col("suspicious") + rest, F.lit(3)))
    text = F.when(bad, F.concat(F.lit("Reputation: MALICIOUS URL — "), "url", F.format_string(" (%d engines flagged malicious, %d suspicious)", "malicious", "suspicious"))) \
        .otherwise(F.concat(F.lit("Reputation: SUSPICIOUS URL — "), "url", F.format_string(" (%d engines flagged suspicious)", "suspicious")))
    return findings(j.filter(bad | odd), "reputation", F.when(bad, "CRITICAL").otherwise("HIGH"), "MaliciousURL", text,
                    evidence=F.col("permalink"), confidence=F.least(F.lit(1.0), conf))
