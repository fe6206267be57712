import os

from packaudit.functions.tables import shared_folder, written
from packaudit.sources import external, packages as src


def _write(root, path, data):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(data)


def test_read_packages(spark, tmp_path):
    root = str(tmp_path / "pk")
    _write(root, "one/SKILL.md", b"---\nname: a\n---\n")
    _write(root, "one/scripts/a.py", b"print('\xff')\n")
    _write(root, "one/scripts/tool.bin", b"\x7fELF....")
    _write(root, "one/scripts/nul.txt", b"ab\x00cd")
    _write(root, "one/.hidden", b"dot file")
    _write(root, "one/img.png", b"not text, not binary")
    _write(root, "one/node_modules/x.js", b"skip")
    _write(root, "one/big.py", b"#" * 512_001)
    _write(root, "one/bigbin.dat", b"MZ" + b"a" * 512_001)
    _write(root, "two/deep/er/x.sh", b"echo 1\n")
    _write(root, ".git/two", b"x")
    _write(root, "two/__init__.py", b"import x\n")
    _write(root, "two/_lib/.deep/y.py", b"y\n")
    _write(root, "two/__pycache__/z.py", b"z\n")
    _write(root, "two/.venv/z.py", b"z\n")
    _write(root, "two/_big.bin", b"\x7fELF" + b"b" * 600_000)
    _write(root, "two/_big.py", b"#" * 600_000)
    _write(root, "three/a.svg", b"<svg/>")
    os.makedirs(os.path.join(root, "four"))
    f = src.read_packages(spark, root)
    got = {(r.skill_id, r.path): r for r in f.collect()}
    assert set(got) == {("one", "SKILL.md"), ("one", "scripts/a.py"), ("one", "scripts/tool.bin"), ("one", "scripts/nul.txt"),
                        ("one", ".hidden"), ("one", "bigbin.dat"), ("two", "deep/er/x.sh"), ("one", "img.png"), ("one", "big.py"), ("two", "_big.py"),
                        ("one", ""), ("two", ""), ("three", ""), ("three", "a.svg"), ("four", ""),
                        ("two", "__init__.py"), ("two", "_lib/.deep/y.py"), ("two", "_big.bin")}
    assert got["one", "scripts/a.py"].content == "print('�')\n"
    assert [p for (_, p), r in sorted(got.items()) if r.is_binary] == ["bigbin.dat", "scripts/nul.txt", "scripts/tool.bin", "_big.bin"]
    assert all(r.content is None for r in got.values() if r.is_binary)
    assert {r.skill_id for r in src.list_packages(f).collect()} == {"one", "two", "three", "four"}
    assert [r.skill_id for r in src.list_packages(f, require_manifest=True).collect()] == ["one"]
    assert src.binary_findings(f).count() == 4
    assert got['two', '__init__.py'].content == 'import x\n'
    assert {r.skill_id for r in src.missing_manifest_findings(f).collect()} == {"two", "three", "four"}
    assert len(got["one", "big.py"].content) == 512_001 and len(got["two", "_big.py"].content) == 600_000
    assert got["one", "img.png"].content is None and got["four", ""].content is None
    limited = src.read_packages(spark, root, max_bytes=512_000)
    assert {(r.skill_id, r.path) for r in limited.collect()} == set(got)
    assert {r.path for r in limited.filter("is_binary").collect()} == {p for (_, p), r in got.items() if r.is_binary}
    assert limited.filter("path in ('big.py', '_big.py') and content is null").count() == 2


def test_large_trees_are_listed_by_many_tasks(spark, tmp_path, monkeypatch):
    """One package holds most folders, another a deep chain; rounds deal what a task does not come to."""
    monkeypatch.setattr(src, "FOLDERS", 20)
    monkeypatch.setattr(src, "DEALT", 4)
    root, want = str(tmp_path / "pk"), set()
    for i in range(300):
        _write(root, f"wide/d{i % 30}/e{i}/a.py", b"x = %d\n" % i)
        want.add(("wide", f"d{i % 30}/e{i}/a.py"))
    deep = "/".join(f"n{i}" for i in range(50))
    _write(root, f"deep/{deep}/z.py", b"z\n")
    _write(root, "top.txt", b"no package\n")
    want |= {("deep", f"{deep}/z.py"), ("deep", ""), ("wide", "")}
    rounds, write = [], src.written
    monkeypatch.setattr(src, "written", lambda df, name: rounds.append(df.rdd.getNumPartitions()) or write(df, name))
    f = src.read_packages(spark, f"file://{root}")
    assert {(r.skill_id, r.path) for r in f.collect()} == want
    assert f.filter("path <> ''").agg({"size": "sum"}).first()[0] == sum(len(b"x = %d\n" % i) for i in range(300)) + 2
    assert max(rounds) > 8 and len(rounds) > 3
    empty = tmp_path / "none"
    empty.mkdir()
    assert src.read_packages(spark, str(empty)).count() == 0


def test_manifest_choice_and_selections(make_files):
    f = make_files({"a": {"skill.md": "x", "Skill.md": "y", "README.md": "r", "z.txt": "t", "sub/q.txt": "no", "scripts/m.md": "e"}, "b": {"SKILL.md": "s", "c.yaml": "k: v"}})
    assert {(r.skill_id, r.path) for r in src.manifest_file(f).collect()} == {("a", "skill.md"), ("b", "SKILL.md")}
    assert [r.path for r in src.injection_files(f).filter("skill_id = 'a'").orderBy("file_order").collect()] == ["skill.md", "README.md", "z.txt"]
    assert {r.path for r in src.non_python_sources(f).collect()} == {"skill.md", "Skill.md", "README.md", "z.txt", "scripts/m.md", "c.yaml"}


def test_external_tables(spark, tmp_path):
    assert external.load_external(spark, "judge_verdicts").count() == 0
    df = spark.createDataFrame([("http://x", 1, 0, 2, 3, "p", "extra")], "url string, malicious int, suspicious int, harmless int, undetected int, permalink string, more string")
    df.write.parquet(str(tmp_path / "rep"))
    assert external.load_external(spark, "url_reputation", str(tmp_path / "rep")).columns[-1] == "permalink"
    try:
        external.conform(df.drop("malicious"), "url_reputation")
        raise AssertionError("a missing column must be refused")
    except ValueError as e:
        assert "malicious" in str(e)


def test_written_tables_live_in_the_shared_folder(spark):
    folder = shared_folder(spark)
    df = written(spark.range(5).selectExpr("id", "id * 2 as x"), "numbers")
    assert df.inputFiles()[0].replace("file://", "").startswith(folder)
    assert "x" not in df.select("id")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_handover_counts_only_when_committed(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    place = f"file://{tmp_path}/over"
    with pytest.raises(ValueError, match="no committed"):
        external.load_phase1(spark, place)
    table = spark.range(30).select(F.col("id").cast("string").alias("skill_id"), F.array(F.struct("id")).alias("more"))
    first = external.save_phase1({"phase1": table, "gaps": table.limit(0)}, place)
    broken = table.withColumn("skill_id", F.when(F.col("skill_id") == "29", F.raise_error(F.lit("lost"))).otherwise(F.col("skill_id")))
    with pytest.raises(Exception, match="lost"):
        external.save_phase1({"phase1": table.limit(3), "gaps": broken}, place)
    got = external.load_phase1(spark, place)  # the one before is what counts
    assert external.handovers(spark, place) == [first] and {k: v.count() for k, v in got.items()} == {"phase1": 30, "gaps": 0}
    assert got["phase1"].schema.simpleString() == table.schema.simpleString()
    second = external.save_phase1({"phase1": table.limit(5)}, place)
    assert external.load_phase1(spark, place, ["phase1"])["phase1"].count() == 5
    assert external.load_phase1(spark, place, ["phase1"], first)["phase1"].count() == 30
    for names, handover, why in ((["gaps"], second, "no table"), (["phase1"], "other", "no committed")):
        with pytest.raises(ValueError, match=why):
            external.load_phase1(spark, place, names, handover)
    table.limit(1).write.mode("append").parquet(f"{place}/{second}/phase1")
    with pytest.raises(ValueError, match="rows handed over"):
        external.load_phase1(spark, place)
    table.withColumn("x", F.lit(1)).write.mode("overwrite").parquet(f"{place}/{first}/phase1")
    with pytest.raises(ValueError, match="columns of phase1"):
        external.load_phase1(spark, place, ["phase1"], first)
