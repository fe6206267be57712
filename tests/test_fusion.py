import math

import pytest

from packaudit.plans import verdicts as ver


def _b(spark, **kw):
    row = {"skill_id": "p", "s2": 0.0, "s3": 0.0, "s_chain": 0.0, "s_check": 0.0, "s1": 0.0, "s4": None, "injection": False, **kw}
    df = spark.createDataFrame([tuple(row.values())], "skill_id string, s2 double, s3 double, s_chain double, s_check double, s1 double, s4 double, injection boolean")
    return ver.decide_b(ver.fuse_b(df)).collect()[0]


@pytest.mark.parametrize("kw,p,verdict", [
    ({}, 0.0794, "PASS"), ({"s2": 0.5, "s3": 0.5}, 0.5, "WARN"), ({"s2": 0.7, "s3": 0.1}, 0.7408, "REVIEW"),
    ({"s1": 0.8, "s4": 0.7}, 0.5866, "WARN"), ({"s2": 0.6, "s3": 0.7, "s_chain": 0.5}, 0.7931, "REVIEW"),
    ({"s2": 0.7, "s3": 0.8, "s_chain": 0.8, "s4": 0.8}, 0.9329, "BLOCK"), ({"s2": 0.5, "s3": 0.7, "s4": 0.75}, 0.7408, "REVIEW")])
def test_calibration(spark, kw, p, verdict):
    r = _b(spark, **kw)
    assert r.p == pytest.approx(p, abs=1e-3) and r.verdict == verdict


def test_injection_floor(spark):
    r = _b(spark, injection=True)
    assert (r.p, r.verdict, r.severity) == (0.97, "BLOCK", "CRITICAL") and r.confidence == pytest.approx(0.94)


def test_floors_a(spark):
    cols = "skill_id string, code_threat double, contract_score double, class_gap double, chain_score double, step_threat double, taint_score double, undeclared_exfil boolean, critical_contract boolean, complete_chain boolean, n_critical int, n_evidence int"
    rows = [("none", 0., 0., 0., 0., 0., 0., False, False, False, 0, 0), ("exfil", 0., 0., 0., 0., 0., 0., True, False, False, 0, 1), ("contract", 0., 0., 0., 0., 0., 0., False, True, False, 1, 1),
            ("chain", 0., 0., 0., 0., 0., 0., False, False, True, 0, 1), ("two", 0., 0., 0., 0., 0., 0., False, False, False, 2, 2), ("code", 1., 0., 0., 0., 0., 0., False, False, False, 0, 1)]
    r = {x.skill_id: x for x in ver.decide_a(ver.fuse_a(spark.createDataFrame(rows, cols))).collect()}
    assert (r["none"].verdict, r["none"].confidence) == ("PASS", 0.9)
    assert [round(r[k].decided, 3) for k in ("exfil", "contract", "chain", "two")] == [0.7, 0.7, 0.75, 0.9]
    assert r["two"].verdict == "BLOCK" and r["two"].confidence == 0.95 and r["contract"].confidence == pytest.approx(0.8)
    assert r["code"].overall == pytest.approx(1 / (1 + math.exp(-6 * 0.45)))


def test_gate(spark):
    df = spark.createDataFrame([("low", 0., 0., 0., 0., False), ("mid", 0.5, 0.5, 0., 0., False), ("high", 1., 1., 1., 1., False), ("inj", 0., 0., 0., 0., True)],
                               "skill_id string, s2 double, s3 double, s_chain double, s_check double, injection boolean")
    assert {r.skill_id: r.needs_judges for r in ver.fast_gate(df).collect()} == {"low": False, "mid": True, "high": False, "inj": False}


def test_evaluation(spark):
    rep = spark.createDataFrame([(str(i), v) for i, v in enumerate(["BLOCK", "REVIEW", "WARN", "PASS", "BLOCK", "PASS"])], "skill_id string, verdict string")
    lab = spark.createDataFrame([(str(i), m) for i, m in enumerate([True, True, True, False, False, False])] + [("9", True)], "skill_id string, is_malicious boolean")
    m = ver.confusion_matrix(ver.label_join(rep, lab)).collect()[0]
    assert (m.tp, m.tn, m.fp, m.fn) == (2, 2, 1, 1)
    assert m.precision == m.recall == m.f1 == pytest.approx(2 / 3) and m.fpr == pytest.approx(1 / 3)
    empty = ver.confusion_matrix(ver.label_join(rep.limit(0), lab)).collect()[0]
    assert (empty.precision, empty.f1) == (0.0, 0.0)
    assert ver.worst_verdict(rep).collect()[0].worst_verdict == "BLOCK"
    assert {r.verdict: r.n_packages for r in ver.batch_summary(rep).collect()} == {"BLOCK": 2, "REVIEW": 1, "WARN": 1, "PASS": 2}
