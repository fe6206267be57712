import random

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from packaudit.operators import contracts as con, reach, reputation as rep, taint
from packaudit.plans import crossmodal

STEP = ("skill_id string, step_index int, step_id string, action string, description string, target_script string, input_refs array<string>, "
        "output_name string, declared_scope string, condition string, branch_true string, branch_false string")
CONTRACT = ("skill_id string, step_id string, allowed_file_reads array<string>, allowed_file_writes array<string>, allowed_network array<string>, "
            "allowed_subprocesses array<string>, allowed_env_vars array<string>, sensitive_ok boolean, network_ok boolean")
IO = "skill_id string, path string, kind string, subtype string, detail string, line int, pos int"
FLAG = "skill_id string, path string, analyzability double, has_obfuscation boolean, has_dynamic_execution boolean, has_encoded_payloads boolean, entry_point boolean"


@pytest.fixture(scope="module")
def result(make_files):
    out = crossmodal.audit(make_files(fx.ALL))
    return {k: v.cache() for k, v in out.items()}


def test_verdicts(result):
    v = {r.skill_id: r for r in result["reports"].collect()}
    assert set(v) == set(fx.ALL)
    assert v["clean"].verdict in ("PASS", "WARN") and v["clean"].n_violations == 0 and v["clean"].n_phantoms == 0
    for bad in ("undeclared", "flow", "injected", "shell", "backshell"):
        assert v[bad].verdict in ("REVIEW", "BLOCK"), bad
    assert all(0 <= r.overall <= 1 and 0 <= r.confidence <= 1 for r in v.values())
    assert v["unreferenced"].n_phantoms == 1 and v["unreferenced"].decided >= v["clean"].decided


def test_declared_use_is_downgraded(result):
    f = result["findings"].filter("skill_id = 'clean' and category = 'CommandInjection'").collect()
    assert [(r.severity, r.original_severity, r.enrichment_action) for r in f] == [("LOW", "MEDIUM", "downgrade")]


def test_undeclared_network(result):
    v = {(r.violation_type, r.severity) for r in result["violations"].filter("skill_id = 'undeclared'").collect()}
    assert ("UNDECLARED_SIDE_EFFECT", "HIGH") in v
    f = result["findings"].filter("skill_id = 'undeclared' and category = 'DataExfiltration'").collect()
    assert [(r.severity, r.original_severity) for r in f] == [("CRITICAL", "HIGH")]


def test_flow_over_three_scripts(result):
    c = result["taint_chains"].filter("skill_id = 'flow'").collect()
    got = {(r.label, r.detail, r.origin_step, r.dest_step, tuple(r.step_path), tuple(r.scripts), r.severity, r.declared) for r in c}
    assert ("ssh_key", ".ssh/id_rsa", "S1", "S3", ("S1", "S2", "S3"), ("scripts/a.py", "scripts/b.py", "scripts/c.py"), "CRITICAL", False) in got
    a = {r.chain_type for r in result["attack_chains"].filter("skill_id = 'flow'").collect()}
    assert "distributed_credential_exfiltration" in a


def test_phantom_upgrade_and_log(result):
    f = result["findings"].filter("skill_id = 'unreferenced' and path = 'scripts/extra.py'").collect()
    assert f and all(r.enrichment_reason.startswith("PHANTOM") for r in f)
    log = result["enrichment_log"].filter("skill_id = 'unreferenced'").count()
    assert log == result["findings"].filter("skill_id = 'unreferenced' and enrichment_action is not null").count()


def test_injected_package(result):
    f = result["findings"].filter("skill_id = 'injected' and analyzer = 'injection'").collect()
    assert len(f) == 1 and f[0].severity == "CRITICAL" and "tier1/direct_override" in f[0].description


def test_contract_checks(spark):
    steps = spark.createDataFrame([("p", i, f"S{i}", "run", "Run the tool", f"s{i}.py", [], "", "", "", "", "") for i in range(1, 8)], STEP)
    none = []
    bounds = spark.createDataFrame([
        ("p", "S1", ["project_dir/**"], none, none, none, none, False, False), ("p", "S2", ["*.csv"], none, none, none, none, True, False),
        ("p", "S3", none, none, ["ok.org"], none, none, False, True), ("p", "S4", none, none, none, ["git"], none, False, False),
        ("p", "S5", ["**"], none, none, ["*"], none, False, True), ("p", "S6", ["**"], none, none, none, none, True, False), ("p", "S7", none, none, none, none, none, False, False)], CONTRACT)
    io = spark.createDataFrame([
        ("p", "x/s1.py", "input", "file_read", "data/a.csv", 1, 1), ("p", "x/s1.py", "input", "file_read", "/etc/passwd", 2, 2), ("p", "x/s1.py", "input", "file_read", "/opt/x", 3, 3),
        ("p", "x/s1.py", "input", "file_read", "<dynamic>", 4, 4), ("p", "x/s1.py", "sensitive_read", "env", "env:TOKEN", 5, 5), ("p", "x/s1.py", "sensitive_read", "path", "~/.aws/config", 5, 6),
        ("p", "s2.py", "input", "file_read", "deep/a.CSV", 1, 1), ("p", "s2.py", "input", "file_read", "a.txt", 1, 2),
        ("p", "s3.py", "effect", "network_request", "https://api.OK.org/x", 1, 1), ("p", "s3.py", "effect", "network_request", "https://other.net", 1, 2),
        ("p", "s4.py", "effect", "subprocess", "/usr/bin/git pull", 1, 1), ("p", "s4.py", "effect", "subprocess", "curl x", 1, 2), ("p", "s4.py", "effect", "subprocess", "<dynamic>", 1, 3),
        ("p", "s5.py", "effect", "subprocess", "rm x", 1, 1), ("p", "s5.py", "input", "file_read", "<dynamic>", 1, 2), ("p", "s5.py", "effect", "network_request", "<dynamic>", 1, 3),
        ("p", "s6.py", "output", "file_write", "/home/u/.ssh/config", 1, 1)] + [("p", "s7.py", "effect", "other", str(i), 1, i) for i in range(4)], IO)
    flags = spark.createDataFrame([("p", x, 1.0, False, x == "s7.py", False, False) for x in ("x/s1.py", "s2.py", "s3.py", "s4.py", "s5.py", "s6.py", "s7.py", "other/s2.py")], FLAG)
    got = {(r.step_id, r.check, r.violation_type, r.severity, r.actual) for r in con.verify_contracts(steps, bounds, io, flags).collect()}
    assert got == {
        ("S1", 1, "SENSITIVE_ACCESS", "CRITICAL", "Reads: ~/.aws/config"), ("S1", 2, "SENSITIVE_ACCESS", "CRITICAL", "Reads: /etc/passwd"),
        ("S1", 2, "SCOPE_EXCEED", "MEDIUM", "Reads: /opt/x"), ("S1", 2, "SCOPE_EXCEED", "MEDIUM", "Dynamic file path"),
        ("S3", 3, "SCOPE_EXCEED", "HIGH", "Accesses: https://other.net"), ("S4", 4, "SCOPE_EXCEED", "MEDIUM", "Runs: curl"),
        ("S6", 5, "SENSITIVE_ACCESS", "CRITICAL", "Writes: /home/u/.ssh/config"), ("S7", 6, "CAPABILITY_INFLATION", "MEDIUM", "5 capabilities for a 3-word description"),
        # the step names s2.py: the exact path wins over other/s2.py, and its pattern misses a.txt only
        ("S2", 2, "SCOPE_EXCEED", "MEDIUM", "Reads: a.txt")}


def test_supplied_contracts_win(spark):
    a = spark.createDataFrame([("p", "S1", ["a"], [], [], [], [], False, False), ("p", "S2", ["b"], [], [], [], [], False, False)], CONTRACT)
    b = spark.createDataFrame([("p", "S2", ["c"], [], [], [], [], True, True)], CONTRACT)
    assert {(r.step_id, r.allowed_file_reads[0]) for r in con.prefer_supplied(a, b).collect()} == {("S1", "a"), ("S2", "c")}


def test_closure_stops_on_cycles_and_carries(spark):
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("p", "c", "d"), ("q", "a", "z")], "skill_id string, from_id string, to_id string")
    seeds = spark.createDataFrame([("p", "a", "x"), ("p", "d", "y")], "skill_id string, id string, tag string")
    got = {(r.id, r.tag, r.depth) for r in reach.closure(seeds, edges, carry=("tag",)).collect()}
    assert got == {("a", "x", 0), ("b", "x", 1), ("c", "x", 2), ("d", "x", 3), ("d", "y", 0)}
    assert {r.id for r in reach.closure(seeds.filter("tag = 'x'"), edges, 1).collect()} == {"a", "b"}


def test_doubling_equals_walking(spark):
    rng = random.Random(7)
    n = 700
    up = {i: (rng.choice([i - 1, i - 1, i - 1, rng.randrange(i)]) if i and rng.random() > 0.02 else None) for i in range(n)}
    own = {i: 1 << rng.randrange(9) if rng.random() < 0.1 else 0 for i in range(n)}
    df = spark.createDataFrame([("p", i, up[i], own[i]) for i in range(n)], "skill_id string, id int, up_id int, bits int")
    want_bits, want_root = {}, {}
    for i in range(n):
        want_bits[i] = own[i] | (want_bits[up[i]] if up[i] is not None else 0)
        want_root[i] = want_root[up[i]] if up[i] is not None else i
    assert {r.id: r.bits for r in reach.inherit_labels(df).collect()} == want_bits
    assert {r.id: r.root for r in reach.roots(df).collect()} == want_root


def test_taint_map_equals_reach(spark):
    rng = random.Random(3)
    steps, io, flags = [], [], []
    for p in range(6):
        for i in range(1, 25):
            refs = [f"S{rng.randrange(1, 26)}.output"] if rng.random() < 0.3 else []
            steps.append((f"p{p}", i, f"S{i}", "run", "d", f"s{i}.py" if rng.random() < 0.8 else "", refs, "" if rng.random() < 0.4 else "o", "", "", "", ""))
            flags.append((f"p{p}", f"s{i}.py", rng.choice([0.3, 1.0]), False, False, False, False))
            if rng.random() < 0.2:
                io.append((f"p{p}", f"s{i}.py", "sensitive_read", "path", rng.choice([".ssh/id_rsa", ".netrc", "x.env"]), 1, 1))
            if rng.random() < 0.5:
                io.append((f"p{p}", f"s{i}.py", "output", "stdout", "", 1, 2))
    st, io_, fl = spark.createDataFrame(steps, STEP), spark.createDataFrame(io, IO), spark.createDataFrame(flags, FLAG)
    linked = con.step_script(st, fl)
    seeds = taint.step_seeds(linked, io_)
    blocked = taint.blocked_steps(linked, io_, fl)
    got = {(r.skill_id, r.step_index): set(r.labels) for r in taint.taint_map(st, seeds, blocked).collect()}
    # the step-by-step statement of the same rule
    label = {".ssh/id_rsa": "ssh_key", ".netrc": "netrc", "x.env": "dotenv"}
    state, want = {}, {}
    for s in steps:
        p, i, script, refs = s[0], s[1], s[5], s[6]
        cur = set()
        for r in refs:
            cur |= state.get((p, int(r.split(".")[0][1:])), set())
        if not refs and i > 1 and next(x for x in steps if x[0] == p and x[1] == i - 1)[7]:
            cur |= state[p, i - 1]
        if script:
            cur |= {label[x[4]] for x in io if x[0] == p and x[1] == script and x[2] == "sensitive_read"}
            a = next(x[2] for x in flags if x[0] == p and x[1] == script)
            out = s[7] or any(x[0] == p and x[1] == script and x[2] == "output" for x in io)
            state[p, i] = cur if a < 0.5 or out else set()
        else:
            state[p, i] = cur
        want[p, i] = state[p, i]
    assert got == want


def test_labels(spark):
    df = spark.createDataFrame([("env:GH_TOKEN",), ("~/.aws/credentials",), ("x/.ssh/config",), ("a/.netrc",), ("odd",)], "d string")
    assert [r.l for r in df.select(taint.taint_label(F.col("d")).alias("l")).collect()] == ["env_secret", "env_secret", "ssh_key", "netrc", "unknown_sensitive"]
    assert df.select(taint.taint_label(F.col("d"), strict=True).alias("l")).collect()[1].l == "aws_credential"


def test_reputation(spark):
    io = spark.createDataFrame([("p", "a.py", "effect", "network_request", u, 1, i) for i, u in enumerate(
        ["https://bad.org/1", "https://bad.org/1", "https://odd.org", "https://github.com/x", "http://localhost:1", "<dynamic>", "https://fine.org"])], IO)
    table = spark.createDataFrame([("https://bad.org/1", 3, 1, 1, 0, "L1"), ("https://odd.org", 0, 1, 9, 0, "L2"), ("https://fine.org", 0, 0, 9, 0, "L3"), ("https://github.com/x", 9, 0, 0, 0, "L4")],
                                  "url string, malicious int, suspicious int, harmless int, undetected int, permalink string")
    got = {(r.severity, r.evidence, round(r.confidence, 3)) for r in rep.reputation_findings(rep.urls_to_check(rep.external_urls(io)), table).collect()}
    assert got == {("CRITICAL", "L1", 0.6), ("HIGH", "L2", 0.1)}


def test_supplied_steps_run_breadth_first(spark):
    from packaudit.operators import steps as stp

    rng = random.Random(13)
    rows, want = [], {}
    for p in range(25):
        n = rng.randrange(1, 12)
        mine = []
        for i in range(1, n + 1):
            jump = lambda: f"S{rng.randrange(1, n + 2)}" if rng.random() < 0.8 else ""
            cond = rng.random() < 0.4
            mine.append((f"p{p}", i, f"S{i}", "run", "d", "", [], "", "", "if" if cond else "", jump(), jump()))
        rows += mine
        by_id, queue, order = {r[2]: r for r in mine}, ["S1"], []
        while queue:
            s = queue.pop(0)
            if s in order or s not in by_id:
                continue
            order.append(s)
            r = by_id[s]
            if r[9]:
                queue += [x for x in (r[10], r[11]) if x]
            if r[1] < n:
                queue.append(f"S{r[1] + 1}")
        want.update({(f"p{p}", s): k + 1 for k, s in enumerate(order)})
    got = {(r.skill_id, r.step_id): r.place for r in stp.step_order(spark.createDataFrame(rows, STEP)).collect()}
    assert got == want
