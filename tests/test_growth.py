"""Plans that must not do work twice or in few tasks, and the helpers they rest on."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packaudit.functions import columns as c
from packaudit.functions import fixed, lines
from packaudit.harness import views as v
from packaudit.harness.queries import QUERIES
from packaudit.operators import graph as g
from packaudit.operators import python_code as py
from packaudit.plans import graph_audit

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_script_io_scans_every_file_once(spark):
    assert plan(QUERIES["python_script_io"](spark, SF)).count("MapInArrow") == 0  # read back: the scan ran before


def test_facts_of_calls_are_made_for_one_branch_each(make_files):
    p = py.parse(make_files({"k": {"a.py": 'import sys\nopen("/x/.ssh/id_rsa")\nopen("/x/.ssh/id_rsa")\nopen("b", "w")\n'}}))
    t = py.tokens(p)
    io = py.python_io(py.calls(t), py.string_literals(t), py.path_divisions(p), py.imports(p), p)
    assert plan(io).count("file_write") == 1
    got = sorted((r.kind, r.subtype, r.detail, r.line) for r in io.collect())
    assert got == [("input", "argv", "sys.argv", 0), ("input", "file_read", "/x/.ssh/id_rsa", 2), ("input", "file_read", "/x/.ssh/id_rsa", 3), ("output", "file_write", "b", 4),
                   ("output", "stdout", "print/stdout", 0), ("sensitive_read", "path", "/x/.ssh/id_rsa", 2)]


def test_scripts_are_worded_after_they_are_dealt(spark):
    text = plan(v.script_files(spark, SF))
    assert text.index("regexp_extract") < text.index("RepartitionByExpression")  # the plan is printed from its root


@pytest.mark.parametrize("sizes, want", [([], []), ([3, 3, 3], [2, 1]), ([9, 1, 5, 9], [1, 2, 1]), ([0, 0, 6], [3])])
def test_portions_of_a_batch(monkeypatch, sizes, want):
    monkeypatch.setattr(py, "PORTION", 6)
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in sizes], pa.string())], ["content"])
    parts = list(py._portions(batch))
    assert [p.num_rows for p in parts] == want
    assert [x for p in parts for x in p.column("content").to_pylist()] == batch.column("content").to_pylist()


def test_lists_of_tuples():
    rows = [[("a", 1), ("é", 2)], None, [], [("", 3)]]
    found = py._lists(rows, ("text", "line")).to_pylist()
    assert found == [[{"text": "a", "line": 1}, {"text": "é", "line": 2}], None, [], [{"text": "", "line": 3}]]
    assert py._lists([None, []], ("text", "line")).to_pylist() == [None, []]


def test_file_flags_scan_once_and_meet_in_one_join(spark):
    text = plan(QUERIES["python_file_flags"](spark, SF))
    assert text.count("MapInArrow") == 0 and text.count("Join") == 1


def test_file_flags_of_each_sign(make_files):
    packed = "".join(chr(33 + i) for i in range(70) if chr(33 + i) not in "\"'\\#")
    texts = {"a.py": "eval(x)\n", "b.py": "getattr(os, 'a')\n", "c.py": f"import {fixed.OBFUSCATION_IMPORTS[0]}\n", "d.py": "x = '__import__'\n", "e.py": f"x = '{packed}'\n", "f.py": "print(1)\n"}
    p = py.parse(make_files({"k": texts}))
    t = py.tokens(p)
    got = {r.path: tuple(r)[2:] for r in py.python_flags(p, py.calls(t), py.string_literals(t), py.imports(p)).collect()}
    no = False
    assert got == {"a.py": (0.3, no, True, no, no), "b.py": (0.5, no, no, no, no), "c.py": (0.4, True, no, no, no), "d.py": (0.3, no, no, no, no), "e.py": (1.0, no, no, True, no), "f.py": (1.0, no, no, no, no)}


def test_evidence_reads_written_facts(spark):
    assert plan(QUERIES["evidence_union"](spark, SF)).count("Relation [event_id") == 1  # the one of the scan


def test_script_facts_come_from_one_read_of_the_events(spark):
    assert plan(v.script_io(spark, SF)).count("Relation") == 1


def test_tier_texts_are_dealt_before_the_rules(spark):
    spread = spark.conf.get("packaudit.spread")
    spark.conf.unset("packaudit.spread")  # as a table that is a single row group
    try:
        assert plan(QUERIES["builtin_tiers_texts"](spark, SF)).count("RepartitionByExpression") == 4
    finally:
        spark.conf.set("packaudit.spread", spread)


OPS = "skill_id string, path string, line int, pos int, id string, op_type string, label string, file_path string, url string, cmd string, var_name string, is_write boolean, is_sensitive boolean, is_external boolean, cmd_dynamic boolean, entropy double, risk double"


def op(line, kind, skill="k", label="l", file_path="", url="", cmd="", var_name="", write=False, dynamic=False, risk=0.6):
    return (skill, "a.py", line, 0, f"c{line}", kind, label, file_path, url, cmd, var_name, write, False, url.startswith("http"), dynamic, 0.0, risk)


def test_chains_of_all_kinds_take_one_window(spark):
    rows = [op(1, "io_op", file_path="~/.ssh/id_rsa"), op(2, "env_op", var_name="V"), op(3, "net_op", url="https://h.example.net"), op(4, "sys_op", label="eval(x)", dynamic=True),
            op(5, "io_op", file_path="~/.bashrc", write=True), op(6, "io_op", file_path="b.csv")]
    found = g.op_chains(spark.createDataFrame(rows, OPS))
    assert plan(found).count("Window [") == 1
    assert sorted((r.node, r.line, r.severity, r.description) for r in found.collect()) == [
        ("c1", 1, "CRITICAL", "Sensitive read «~/.ssh/id_rsa» (a.py:1) flows to external network call «https://h.example.net» (a.py:3)"),
        ("c2", 2, "HIGH", "Env var «V» (a.py:2) flows to external endpoint «https://h.example.net» (a.py:3)"),
        ("c3", 3, "CRITICAL", "Network fetch (a.py:3) flows to dynamic exec/eval «eval(x)» (a.py:4)"),
        ("c5", 5, "HIGH", "Write to persistence path «~/.bashrc» at a.py:5")]


def test_overlap_counts_in_one_pass(spark):
    declared = spark.createDataFrame([("a", ["data", "make"]), ("b", []), ("c", ["x"]), ("d", [])], "skill_id string, normal array<string>")
    observed = spark.createDataFrame([("a", "data/f1"), ("a", "data/f2"), ("a", "gcc"), ("b", "z"), ("e", "z"), ("c", None)], "skill_id string, scope string")
    found = g.fuzzy_overlap(declared, observed, ["skill_id"])
    assert plan(found).count("Join") == 2
    assert {r.skill_id: r.similarity for r in found.collect()} == {"a": pytest.approx(1 / 5), "b": 0.0, "c": 0.0, "d": 1.0, "e": 0.0}


def test_covers_and_declared_over_lists_of_a_package(spark):
    ops = spark.createDataFrame([op(1, "io_op", file_path="Data/F1.csv"), op(2, "io_op", file_path=None), op(3, "net_op", url="https://H1.example.net/e"), op(4, "sys_op", cmd="Make -C d"), op(5, "env_op")], OPS)
    perms = spark.createDataFrame([("k", 0, "File_Read", "data"), ("k", 1, "network", None), ("k", 2, None, "all"), ("k", 3, "shell", "x")], "skill_id string, pos int, perm_type string, scope string")
    edges = g.covers_edges(ops, perms)
    assert sorted((r.from_id, r.to_id) for r in edges.collect()) == [("perm:0:File_Read:data", "c1"), ("perm:1:network", "c3"), ("perm:3:shell:x", "c4")]
    scopes = spark.createDataFrame([("k", ["data"], [], ["h1"], ["make"], False)], "skill_id string, file_read array<string>, file_write array<string>, network array<string>, subprocess array<string>, sensitive_access boolean")
    assert {r.id: r.declared for r in g.declared_ops(ops, scopes).collect()} == {"c1": True, "c2": None, "c3": True, "c4": True, "c5": True}


def test_only_texts_with_a_match_are_cut_apart(spark):
    files = spark.createDataFrame([("k", "a", "x\ny7\n8"), ("k", "b", "none"), ("k", "c", None)], "skill_id string, path string, content string")
    found = lines.match_lines(files, ["skill_id", "path"], "([0-9])")
    assert "RLIKE(content" in plan(found)
    assert sorted((r.path, r.m, r.line) for r in found.collect()) == [("a", "7", 2), ("a", "8", 3)]


def test_marks_of_encoding_calls_lose_no_match(spark):
    names = ["base64", "b64decode", "b64encode", "zlib.decompress", "codecs.decode", "rot13", "binascii"]
    forms = [x for n in names for x in (n, n.upper(), n.title(), n.replace("s", "ſ"), n.replace("i", "ı"), n.replace("i", "İ"), f"é {n}(x)", f"x{n}")] + ["", "nameless", "13 64 .de na", None]
    rows = spark.createDataFrame([(x,) for x in forms], "t string").select("t", c.is_encoding_b(F.col("t")).alias("a"), c.matches(F.col("t"), fixed.OBFUSCATION_B).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(bool(r.b) for r in rows) > 40


def test_audit_states_over_reach_once(spark, monkeypatch, make_files):
    calls, real = [], g.over_reach_rows
    monkeypatch.setattr(g, "over_reach_rows", lambda *a: calls.append(1) or real(*a))
    first = graph_audit.phase1(make_files({"k": {"SKILL.md": "---\nname: k\n---\n1. Go\n", "scripts/a.py": 'import os\nos.system("gcc d")\neval(x)\nopen("out/z", "w")\n'}}))
    assert len(calls) == 1
    want = {"file_write: 'out/z' not declared in NL": 0.15, "subprocess: 'gcc' not declared in NL": 0.10, "subprocess: dangerous eval/exec not declared": 0.30}
    assert {r.gap: r.weight for r in first["gaps"].collect()} == pytest.approx(want)
    assert first["phase1"].first().over_reach == pytest.approx(0.55)
