import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from packaudit.llm import decisions, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """Counts of a text by plain code."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i:i + 3]), []).append(i)
    again = {p + k for places in at.values() if len(places) > 1 for p in places for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice(["a", "b", "ré", "日本", "x#y", "🎉", "c|", "word", "<s>", " ", " "]) for _ in range(rng.choice([0, 1, 2, 3, 5, 20, 90]))]
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\t", "\x0b", "\r\n", "\n\n"]) for w in words))
    return out


def counted(stats):
    return sorted((r["path"] or "", *(r[c] for c in decisions.COUNTS)) for r in stats.collect())


@pytest.mark.parametrize("bits", [24, 63, 58, 4])
def test_counts(package_files, hard_rows, prose, monkeypatch, bits):
    """Also where hashes have so few bits that windows clash, or places so few that texts are too long."""
    monkeypatch.setattr(decisions, "PLACE_BITS", bits)
    rows = [*hard_rows, *((f"t/{i:03}", t) for i, t in enumerate(texts(bits, 60))), ("r/same", "la " * 500), ("r/loop", prose(4, 90) + "\n" + prose(4, 90)), ("r/none", "a b c d e f g")]
    files = package_files(rows)
    assert counted(decisions.statistics(files)) == sorted((p or "", *plain(t)) for p, t in rows)
    assert decisions.statistics(files.limit(0)).count() == 0


def test_plan_is_native(package_files, hard_rows):
    plan = decisions.judge(package_files(hard_rows), package_files(hard_rows).select("path", F.lit(1).alias("label")))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)


def stats_of(spark, rows):
    columns = ["path", *decisions.COUNTS, *decisions.MEASURES[1:]]
    return spark.createDataFrame([(p, 100, 500, 0, 0, 0, *m) for p, m in rows], ", ".join(f"{c} {'string' if i == 0 else 'long' if i <= 5 else 'double'}" for i, c in enumerate(columns)))


def test_list_is_learned(spark):
    """Two kinds of bad texts, each a box in two measures, are found as rules; nothing else is rejected."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(3000):
        m = [rng.random() for _ in range(8)]
        bad = (m[1] > 0.7 and m[3] <= 0.4) or m[5] > 0.9
        rows.append((f"p/{i}", m))
        if i % 3:
            labels.append((f"p/{i}", int(not bad)))
    labels += [("p/unknown", 0), ("p/1", None)]
    stats = stats_of(spark, rows)
    rules = decisions.learn(stats, spark.createDataFrame(labels, "path string, label int"))
    assert 2 <= len(rules) <= 6
    got = {r["path"]: r["rule"] for r in stats.select("path", decisions.fired(rules).alias("rule")).collect()}
    wrong = sum((got[p] is not None) != ((m[1] > 0.7 and m[3] <= 0.4) or m[5] > 0.9) for p, m in rows)
    assert wrong < 0.03 * len(rows)
    by_hand = {p: next((str(r) for r in rules if all((m[decisions.MEASURES.index(c.measure) - 1] > c.threshold) == c.above for c in r.conditions)), None) for p, m in rows}
    assert got == by_hand


def test_without_labels(spark, package_files, hard_rows):
    files = package_files(hard_rows)
    none = spark.createDataFrame([], "path string, label int")
    for labels in (none, files.select("path", F.lit(1).alias("label"))):
        rows = decisions.judge(files, labels).collect()
        assert len(rows) == len(hard_rows) and all(r["kept"] == (not r["base_failed"]) and r["rule"] is None for r in rows)
    assert decisions.judge(files.limit(0), none).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op13_decisions"](spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sorted((r["doc_id"], *(r[c] for c in decisions.COUNTS)) for r in got) == sorted((i, *plain(t)) for i, t in docs.items())
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    assert all(not (r["kept"] and r["base_failed"]) for r in got)
    judged = [(r["kept"], labels[r["doc_id"]]) for r in got if not r["base_failed"] and r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(k == bool(q) for k, q in judged) >= 0.95 * len(judged) and all(k for k, q in judged if q)
