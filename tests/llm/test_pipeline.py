import collections

import public_tokenizers
import pytest

import corpus_pipeline as P
from surveyq.llm.quality import classify
from tests.llm.test_corpus_operators import check_packing, deduped, hits, near_brute


def test_pipeline_against_brute_force(spark, sf):
    """Every stage on what its predecessor kept; the classifier's verdicts are its own, the rest is brute force."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    good = {r.doc_id for r in classify(docs, labels).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    rows = [(k[0], k[3]) for k in deduped(rows)]
    rows.sort()
    keep = {k[0] for k in near_brute(rows, 80) if k[3]}
    rows = [r for r in rows if r[0] in keep]
    bad = {k[0] for k in hits(rows, [(r.item_id, r.text) for r in bench.collect()]) if k[5]}
    rows = [r for r in rows if r[0] not in bad]
    got = P.run(spark, sf).collect()
    check_packing(got, rows)
    assert {r.doc_id for r in got} == {i for i, _ in rows} and bad


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dup", "decontaminate", "packing"]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes, name
        nothing = stage(spark, docs.limit(0), sf)
        assert nothing.dtypes == docs.dtypes and nothing.count() == 0, name
