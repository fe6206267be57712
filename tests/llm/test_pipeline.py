import sys

import public_tokenizers
import sentencepiece

import __spark_entry__
import corpus_pipeline
from oracle_check import compare, connect
from packaudit.llm import private, queries, simhash

SF = "/root/testdata/sf0.001"


def test_registered():
    names = __spark_entry__.queries()
    assert {*queries.QUERIES, "pipeline"} <= set(names)
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, len(queries.QUERIES) + 1))


def test_mixture_equals_sql(spark):
    assert compare(queries.QUERIES["op5_mixture"](spark, SF), connect(SF), queries.ORACLE["op5_mixture"]) == ""


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF))
    assert all(f.columns == docs.columns for f in frames[:-1])
    raw, good, single, clean, mixed = ([r.asDict() for r in f.collect()] for f in frames[:-1])
    scores = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op2_quality"](spark, SF).collect()}
    assert {r["doc_id"] for r in good} == {i for i, p in scores.items() if p}
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in good}
    group = {}
    for i in sorted(prints):  # smallest document of each group, by plain search
        near = {group[j] for j in group if (prints[i] ^ prints[j]).bit_count() <= 4}
        top = min({i, *near})
        group[i] = top
        group.update({j: top for j, t in group.items() if t in near})
    assert {r["doc_id"] for r in single} == set(group.values())
    texts = {r["doc_id"]: r["text"] for r in clean}
    for r in single:
        assert (texts[r["doc_id"]] == r["text"]) == (private.spans(r["text"]) == [])
        assert private.spans(texts[r["doc_id"]]) == []
    assert all(r["n_chars"] == len(r["text"]) for r in clean)
    assert {r["doc_id"] for r in mixed} <= set(texts) and all(texts[r["doc_id"]] == r["text"] for r in mixed)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = frames[-1].collect()
    assert sorted(r["doc_id"] for r in last) == sorted(r["doc_id"] for r in mixed)
    assert all(r["ids"] == library.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["text"] == library.decode(r["ids"]) for r in last)


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    rows = lambda d: sorted((r["doc_id"], r["n_tokens"], r["ids"], r["text"]) for r in d.collect())
    want = rows(docs)
    assert len(want) > 50 and rows(corpus_pipeline.run(spark, SF)) == want
    assert "packaudit.llm.stages" in sys.modules
