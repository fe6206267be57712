import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from oracle_check import compare, connect
from packaudit.llm import merkle, queries

SF = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests):
    """Root and, per leaf, (side, sibling) of each level, by plain levels."""
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    ways = []
    for i in range(len(digests)):
        way = []
        for level in levels[:-1]:
            j = i ^ 1
            way.append((0, "") if j >= len(level) else (1 if j > i else -1, level[j]))
            i //= 2
        ways.append(way)
    return levels[-1][0], ways


def brute(rows, fields=("skill_id", "path", "content")):
    """{(package, path, leaf, position): (way, subroot, root)} of dict rows."""
    first = lambda v: (v is not None, v if v is not None else "")
    groups = {}
    for r in rows:
        groups.setdefault(r["skill_id"], []).append((first(r["path"]), sha(*(framed(r[f]) for f in fields)), r["path"]))
    order = sorted(groups, key=lambda g: first(g.encode() if g else g and g) if g is None else (True, g.encode().decode("latin-1")))
    trees = {g: tree([d for _, d, _ in sorted(groups[g], key=lambda x: x[:2])]) for g in order}
    root, above = tree([trees[g][0] for g in order])
    out = []
    for g, up in zip(order, above):
        for k, (_, d, path) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            out.append((g or "", path or "", d, k, trees[g][1][k] + up, trees[g][0], root))
    return sorted(out)


def found(table):
    return sorted((r["skill_id"] or "", r["path"] or "", r["leaf"], r["position"], [(s["side"], s["digest"]) for s in r["siblings"]], r["subroot"], r["root"]) for r in table.collect())


def test_frontier_is_the_plain_tree():
    for n in range(1, 70):
        digests = [sha(str(i)) for i in range(n)]
        f = merkle.Frontier()
        for d in digests:
            f.append(d)
        root = f.close()
        assert (root, f.witnesses) == tree(digests)
    f = merkle.Frontier()
    f.append("a")
    assert f.close(2) == sha(sha("a")) and f.witnesses == [[(0, ""), (0, "")]]


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_is_the_plain_tree(package_files, prose, hard_rows, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 1 << height)
    rng = random.Random(height)
    rows = [*hard_rows, *((f"big/f{i:03}.md", prose(i, 5)) for i in range(75)), *((f"g{rng.randrange(9)}/f{i}.md", prose(i, 3)) for i in range(25)), *([("big/same.md", "la")] * 9)]
    files = package_files(rows).withColumn("root", F.lit("taken")).withColumn("skill_id", F.when(F.col("path").startswith("g3"), F.lit(None)).otherwise(F.col("skill_id")))
    want = brute([r.asDict() for r in files.collect()])
    got = merkle.manifest(files)
    assert found(got) == want
    folded = got.select("leaf", "root", merkle.fold(F.col("leaf"), F.col("siblings")).alias("folded"), merkle.proof(F.col("siblings")).alias("proof"), "siblings").collect()
    assert all(r["folded"] == r["root"] and r["proof"] == sha(*(s["digest"] for s in r["siblings"])) for r in folded)
    wrong = got.select((merkle.fold(F.sha2("leaf", 256), F.col("siblings")) == F.col("root")).alias("same")).collect()
    assert not any(r["same"] for r in wrong)


def test_few_rows(package_files):
    assert merkle.manifest(package_files([]).limit(0)).collect() == []
    one = merkle.manifest(package_files([("a/b.md", None)])).collect()
    assert [(r["siblings"], r["root"] == r["leaf"] == r["subroot"], r["position"]) for r in one] == [([], True, 0)]
    singles = package_files([(f"p{i}/x.md", str(i)) for i in range(5)])
    assert found(merkle.manifest(singles)) == brute([r.asDict() for r in singles.collect()])


def test_leaf_frames_values(spark):
    row = spark.createDataFrame([(7, None, "é:x", "")], "a long, b string, c string, d string").select(merkle.leaf("a", "b", "c", "d").alias("h")).first()
    assert row["h"] == sha("1:7", "-", "4:é:x", "0:")


def test_query(spark):
    got = queries.QUERIES["op11_merkle"](spark, SF)
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    groups = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        groups.setdefault(r["lang"], []).append(r)
    trees = {g: tree([sha(*(framed(r[f]) for f in fields)) for r in groups[g]]) for g in sorted(groups)}
    root, above = tree([t[0] for t in trees.values()])
    want = []
    for (g, (subroot, ways)), up in zip(trees.items(), above):
        for r, way in zip(groups[g], ways):
            leaf = node = sha(*(framed(r[f]) for f in fields))
            if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                node = sha(*(framed(r[f] + (f == "n_chars") if f == "n_chars" else r[f]) for f in fields))
            for side, digest in way + up:
                node = sha(digest, node) if side < 0 else sha(node, digest)
            want.append((r["doc_id"], leaf, subroot, root, sha(*(d for _, d in way + up)), node, node == root))
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want)
    assert compare(got, connect(SF), __spark_entry__.oracle_sql()["op11_merkle"]) == ""
