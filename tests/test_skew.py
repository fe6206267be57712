"""Results stay right when one user, source or conversation holds a third of all rows."""

import pytest

from oracle_check import TABLES, compare, connect
from packaudit.harness.oracle import ORACLE
from packaudit.harness.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("skew"))
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "events":
            df = df.selectExpr("event_id", "ts", "if(event_id % 3 = 0, 7, user_id) user_id", "event_type", "value", "props")
        if t == "documents":
            df = df.selectExpr("doc_id", "text", "lang", "if(doc_id % 3 = 0, 'src0', source) source", "n_chars")
        if t == "conversations":
            more = spark.range(90).selectExpr("cast(7000 as bigint) conv_id", "id turn", "element_at(array('user', 'assistant', 'system'), cast(id % 3 + 1 as int)) role", "repeat('x', cast(id as int)) text")
            df = df.unionByName(more)
        df.coalesce(1).write.parquet(f"{out}/parts/{t}")
        import glob
        import shutil

        shutil.copy(glob.glob(f"{out}/parts/{t}/*.parquet")[0], f"{out}/{t}.parquet")
    return out


@pytest.mark.parametrize("name", [
    "finding_topn", "finding_numbering", "finding_dedupe", "repeat_flood", "weighted_rules_confidence", "encoded_runs", "python_code_ops", "ctrl_flow_edges", "reach_within_k",
    "op_score_topn", "declared_ops", "covers_edges", "fuzzy_overlap", "taint_fixed_point", "step_taint_labels", "taint_chains", "step_order", "contract_violations", "attack_chains"])
def test_skewed(spark, skewed, name):
    assert compare(QUERIES[name](spark, skewed), connect(skewed), ORACLE[name]) == ""
