import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from oracle_check import compare, connect
from packaudit.llm import prefixes, queries

SF = "/root/testdata/sf0.001"
COLUMNS = prefixes.RESULT


def brute(sequences):
    """Nodes of {key: [(action, description), ...]} by plain prefixes."""
    members = {}
    for key, steps in sequences.items():
        for d in range(len(steps) + 1):
            members.setdefault(tuple(steps[:d]), []).append(key)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[:len(p)] == p] for p in members}

    def below(p):
        leaves, saved = (0, 0) if kids[p] else (1, 0)
        for q in kids[p]:
            a, b = below(q)
            leaves, saved = leaves + a, saved + b
        return leaves, saved + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)

    out = []
    for p, own in members.items():
        ends = ",".join(map(str, sorted(k for k in own if len(sequences[k]) == len(p))))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(kids[p]), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(nodes):
    return sorted((tuple(r[c] for c in COLUMNS) for r in nodes.collect()), key=lambda r: r[:2])


def step_rows(spark, sequences, key="long"):
    rows = [(k, i * 10, a, d, "taken", -1) for k, steps in sequences.items() for i, (a, d) in enumerate(steps)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, f"skill_id {key}, step_index long, action string, description string, item string, depth int")


def run(spark, sequences, key="long"):
    names = spark.createDataFrame([(k, 7) for k in sequences], f"skill_id {key}, n_skills int")
    return prefixes.trie(prefixes.in_order(prefixes.items(step_rows(spark, sequences, key))), names)


def made(seed, packages, alphabet=3, longest=9):
    rng = random.Random(seed)
    words = ["run", "read é", "", "write a longer text 🎉"]
    return {k: [(rng.choice(["run", ""]), words[rng.randrange(alphabet)]) for _ in range(rng.randrange(longest))] for k in range(packages)}


@pytest.mark.parametrize("limit", [1, 12, 50_000])
def test_trie(spark, monkeypatch, limit):
    monkeypatch.setattr(prefixes, "LIMIT", limit)
    monkeypatch.setattr(prefixes, "CHAIN", 4)
    shared = [("run", f"step {i}") for i in range(11)]
    sequences = made(limit, 30) if limit == 1 else made(limit, 60)
    sequences |= {100 + i: shared[:7 + i % 3] for i in range(12)}  # copies, and some that end inside others
    sequences |= {200: shared + [("a", "b")], 201: shared + [("a", "c")] + shared, 300: [], 301: []}
    sequences |= {-5: [("", "only")] * 40}
    assert found(run(spark, sequences)) == brute(sequences)


def test_one_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "LIMIT", 20)
    same = {i: [("run", "a"), ("run", "b"), ("end", "c")] for i in range(50)}
    assert found(run(spark, same)) == brute(same)


def test_text_keys_and_few_rows(spark):
    sequences = {"b/x": [("run", "a")], "a": [("run", "a"), ("run", "")], "c,": []}
    assert found(run(spark, sequences, "string")) == brute(sequences)
    nothing = step_rows(spark, {})
    assert found(prefixes.trie(prefixes.in_order(prefixes.items(nothing)))) == []
    assert found(run(spark, {4: [], 9: []})) == brute({4: [], 9: []})


def test_nulls_ties_and_repeats(spark):
    rows = [(1, None, "run", "first"), (1, 3, None, None), (1, 2, "run", "x"), (1, 2, "run", "x"), (None, 1, "run", "lost"), (2, None, "run", "first"), (2, 5, "run", "x"), (2, 5, "run", "x"), (2, 7, "", "")]
    steps = spark.createDataFrame(rows, "skill_id long, step_index long, action string, description string")
    same = [("run", "first"), ("run", "x"), ("run", "x"), ("", "")]
    assert found(prefixes.trie(prefixes.in_order(prefixes.items(steps)))) == brute({1: same, 2: same})


def test_long_sequence(spark, monkeypatch):
    """A package with most of all steps, and one that shares half of them."""
    monkeypatch.setattr(prefixes, "LIMIT", 500)
    long = [("run", str(i % 97)) for i in range(3000)]
    sequences = {1: long, 2: long[:1500] + [("run", "other")], 3: [("run", "0"), ("run", "9")]}
    nodes = found(run(spark, sequences))
    assert len(nodes) == 3000 + 1 + 1 + 1
    own = {(m, d): r for m, d, *r in nodes}
    root_saved = sum(len(d) for _, d in long[:1500]) + 1  # packages 1 and 2, and step "0" of package 3
    assert own[1, 0] == [None, 3, 1, 3, root_saved, prefixes.NO_ENDS]
    assert own[1, 1500][1:4] == [2, 2, 2] and own[1, 3000][1:5] == [1, 0, 1, 0] and own[3, 2][0] == 1


def test_query(spark):
    rows = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows.setdefault(r["conv_id"], []).append(((r["turn"] is not None, r["turn"] or 0), (r["role"] or "", r["text"] or "")))
    turns = {c: [t for _, t in sorted(v)] for c, v in rows.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
    want = brute({c: turns.get(c - c % 100, [])[:h[c]] + t[h[c]:] for c, t in turns.items()})
    got = queries.QUERIES["op12_prefixes"](spark, SF)
    assert found(got.withColumnsRenamed({"conv_id": "skill_id", "parent_conv_id": "parent_skill_id", "n_convs": "n_skills", "saved_tokens": "saved_chars"})) == want
    assert compare(got, connect(SF), __spark_entry__.oracle_sql()["op12_prefixes"]) == ""
    assert dict(got.dtypes)["depth"] == "bigint" and got.where(F.col("depth") == 0).count() == 1
