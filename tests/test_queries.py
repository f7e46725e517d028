"""Every query against its SQL twin, and plans that have to stay in the JVM."""

import importlib
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from surveyq.plans.registry import ORACLES, QUERIES
from tests.conftest import DATA, ROOT

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
#: Queries that need Python on the executors: matrix products, greedy choices and stand-in models.
PYTHON = {"j13_cross_pairs", "w2_top_neighbours", "ag7_repetition", "m11_rouge_l", "j14_j15_greedy_match", "c5_cascade"}
PYTHON |= {"t18_trained_sentences", "j14_threshold_join", "sk3_c10_attempts", "m3_ordered_alignment", "m1_learned_embedding", "sc17_zip_members"}
PYTHON |= {"c5_cascade_references", "sc17_archives", "t28_bibtex", "t29_bibliography", "t30_numbered_citations", "t34_lcs", "m1_embedding", "c6_cascade_concat"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0) if v == v else "nan"
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows, columns = df.collect(), sorted(df.columns)
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
        assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == want
    plan = df._jdf.queryExecution().toString()
    if name not in PYTHON:
        assert not any(x in plan for x in ("PythonUDF", "ArrowEvalPython", "InPandas", "InArrow")), name
    assert "CartesianProduct" not in plan


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_llm_folders(tmp_path):
    """Imports with surveyq.llm and the pipeline hidden."""
    code = (
        "import sys\n"
        "class Hide:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('surveyq.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Hide())\n"
        "import __spark_entry__ as e\n"
        "assert 'q1_delta_summary' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_no_import_of_llm_elsewhere():
    import pathlib

    for p in pathlib.Path(ROOT, "surveyq").rglob("*.py"):
        if "llm" not in p.parts:
            assert "surveyq.llm" not in p.read_text(), p
    assert importlib.import_module("surveyq") and DATA


@pytest.mark.parametrize(
    "name,needs,lacks",
    [
        ("sk3_pending", ["EqualTo(quality,1)", "ReadSchema: struct<doc_id:bigint>"], ["toxic"]),
        ("q1_delta_summary", ["In(o_orderstatus", "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>"], ["o_orderpriority", "c_acctbal"]),
        ("sc5_corpus_scan", ["LeftSemi", "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)"], ["n_chars", "lang"]),
        ("ag9_metric_summary", ["partial_"], ["o_orderdate"]),
    ],
)
def test_scans_are_pruned(spark, sf, name, needs, lacks):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for part in needs:
        assert part in plan, (part, plan)
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and not any(word in line for line in scans for word in lacks)
