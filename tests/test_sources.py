import io
import json
import os
import tarfile
import zipfile

from pyspark.sql import functions as F

from surveyq.sources import surveys as R
from surveyq.streaming.resume import first_seen, process_new, windowed_counts


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=1))


def test_generations(spark, tmp_path):
    d = tmp_path / "generations" / "ds_mod_el"
    put(d / "10.json", {"id": "10", "dataset_id": "ds", "model_id": "mod_el", "query": "q", "text": "t", "success": True, "meta": {"references": [{"idx": None, "title": "A"}, {"idx": 7, "doc_id": 0}]}})
    put(d / "2.json", {"topic_id": "2", "topic": "old", "generated_text": "g", "error": None})
    put(d / "x.json", {"id": "x", "text": "", "success": True})
    put(d / "3_old.json", {"id": "3"})
    put(d / "bad.json", "{not json")
    gens = R.read_generations(spark, f"file://{tmp_path}/generations")
    assert [r.stem for r in R.ordered(gens).collect()] == ["2", "10", "x"]
    got = {r.id: r for r in gens.collect()}
    assert (got["2"].query, got["2"].text, got["2"].success, got["2"].dataset_id, got["2"].model_id) == ("old", "g", True, "ds", "mod_el")
    refs = {r.pos: r for r in R.references(gens).collect()}
    assert (refs[0].idx, refs[1].idx, refs[1].doc_id) == (1, 7, 0)
    assert [r.id for r in gens.where(R.VALID["generation"]()).orderBy("id").collect()] == ["10", "2"]
    left = R.pending(gens.select("id"), gens, ["id"], R.VALID["generation"]())
    assert [r.id for r in left.collect()] == ["x"]


def test_runs(spark, tmp_path):
    for name in ("ds_a_b_factuality_v1", "ds_a_b_Expert", "ds_c_surge_k5", "nothing"):
        put(tmp_path / "scores" / name / "1.json", {"id": "1", "scores": {"m": 0.5}})
    put(tmp_path / "scores" / "ds_c_surge_k5" / "summary.json", {})
    put(tmp_path / "scores" / "ds_c_surge_k5" / "2.json", {"topic_id": "2", "survey_title": "T", "scores": {"m": 1.0}})
    runs = {r.dir: r for r in R.discover_runs(spark, f"file://{tmp_path}/scores").collect()}
    assert set(runs) == {"ds_a_b_factuality_v1", "ds_a_b_Expert", "ds_c_surge_k5"}
    r = runs["ds_a_b_factuality_v1"]
    assert (r.dataset, r.model, r.kind, r.suffix, r.n_files) == ("ds", "a_b", "factuality", "_v1", 1)
    assert runs["ds_a_b_Expert"].kind == "expert" and runs["ds_c_surge_k5"].n_files == 2
    scores = {r.id: r for r in R.read_scores(spark, f"file://{tmp_path}/scores/ds_c_surge_k5", "m:double").collect()}
    assert (scores["2"].title, scores["2"].scores.m, scores["1"].title) == ("T", 1.0, "")
    dirs = spark.createDataFrame([("ds_A_B",), ("ds_c",)], "dir string")
    assert sorted(r.model for r in R.models(dirs, R.discover_runs(spark, f"file://{tmp_path}/scores")).collect()) == ["A_B", "c"]
    assert [r.dataset for r in R.datasets(dirs).collect()] == ["ds"]


def test_other_inputs(spark, tmp_path):
    put(tmp_path / "topics.txt", "one\n\n# no\n two \n")
    assert [r.topic for r in R.read_topics(spark, f"file://{tmp_path}/topics.txt").collect()] == ["one", "two"]
    put(tmp_path / "human" / "Graph-Nets.md", "# Intro\ntext")
    put(tmp_path / "human" / "vision" / "paper.txt", "plain")
    put(tmp_path / "human" / "README.md", "skip")
    aliases = spark.createDataFrame([("graph_net", "graphs", 0), ("vision", "vision", 1)], "alias string, topic string, ord int")
    got = {r.title: r for r in R.human_surveys(spark, f"file://{tmp_path}/human", aliases).collect()}
    assert (got["Graph-Nets"].topic, got["Graph-Nets"].outline, got["paper"].topic) == ("graphs", "# Intro", "vision") and len(got) == 2
    put(tmp_path / "base" / "7" / "any.json", {"survey": "S"})
    q = spark.createDataFrame([("7", "the query")], "id string, query string")
    r = R.baseline_generations(spark, f"file://{tmp_path}/base", q, "ds", "auto").head()
    assert (r.id, r.query, r.text, r.success) == ("7", "the query", "S", True)


def test_archives(spark, tmp_path):
    body = json.dumps({"id": "1", "text": "t"}).encode()
    (tmp_path / "in").mkdir()
    with tarfile.open(tmp_path / "in" / "a.tar.gz", "w:gz") as t:
        for name, data in (("d/1.json", body), ("../evil.json", body), ("d/x.txt", b"x"), ("d/2.json", b"{}")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    with zipfile.ZipFile(tmp_path / "in" / "b.zip", "w") as z:
        z.writestr("3.json", body)
    names = [r.name for r in R.archive_members(spark, f"file://{tmp_path}/in").orderBy("name").collect()]
    assert names == ["3.json", "d/1.json", "d/2.json"]
    assert R.archived_generations(spark, f"file://{tmp_path}/in").count() == 2
    have = spark.createDataFrame([("d/1.json",)], "name string")
    assert R.new_members(R.archive_members(spark, f"file://{tmp_path}/in"), have).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "ds", "m", 0.5), ("2", "ds", "n", None)], "id string, dataset_id string, model_id string, score double")
    R.write_surveys(df, f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "dataset_id=ds" / "model_id=m").is_dir()
    R.write_summary(df, f"file://{tmp_path}/csv", ["id", "score", "missing"])
    (name,) = [f for f in os.listdir(tmp_path / "csv") if f.endswith(".csv")]
    assert (tmp_path / "csv" / name).read_text().splitlines()[0] == "id,score,missing"
    v = spark.range(1).select(R.run_id(F.lit("alignscore"), F.lit(None), F.lit("k 5"), F.lit("")).alias("v")).head().v
    assert v == "alignscore_k_5" and "supported" not in R.strip_variant(df.withColumn("supported", F.lit(True))).columns


def test_stream_resumes(spark, tmp_path):
    put(tmp_path / "in" / "1.json", {"id": "1", "text": "a"})
    args = (spark, f"file://{tmp_path}/in", "id string, text string", f"file://{tmp_path}/done", f"file://{tmp_path}/ck")
    step = lambda df: first_seen(df, ["id"]).withColumn("n", F.length("text"))
    process_new(*args, step).awaitTermination(60)
    put(tmp_path / "in" / "2.json", {"id": "2", "text": "bb"})
    put(tmp_path / "in" / "3.json", {"id": "1", "text": "again"})
    process_new(*args, step).awaitTermination(60)
    assert sorted((r.id, r.n) for r in spark.read.parquet(f"file://{tmp_path}/done").collect()) == [("1", 1), ("2", 2)]


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "ts string, kind string, v double")
    got = windowed_counts(df, "ts", "kind", "v").orderBy("window_start").collect()
    assert [(r.n, r.total) for r in got] == [(2, 3.0), (1, 4.0)]


def test_zips_are_read_by_ranges_of_members(spark, tmp_path):
    import io
    import zipfile

    from surveyq.sources import archives as Z

    folder = f"file://{tmp_path}/zips"
    df = spark.createDataFrame([(f"{'../' if i == 5 else 'a/'}{i}.{'txt' if i == 6 else 'json'}", None if i == 7 else f"text é {i}" * 50) for i in range(40)], "n string, c string")
    assert Z.write_zips(df.repartition(3), folder, "n", "c") == 40
    with zipfile.ZipFile(tmp_path / "zips" / "more.zip", "w") as z:
        for i in range(100, 130):
            z.writestr(f"b/{i}.json", f"{i}" * 30)
    (tmp_path / "zips" / "none.zip").write_bytes(_empty_zip(io, zipfile))
    found = Z.read_zips(spark, folder, 400)
    assert found.rdd.getNumPartitions() > 8  # four archives, one without members
    got = {r.name: r.content for r in found.collect()}
    want = {r.n: r.c or "" for r in df.collect() if r.n not in ("../5.json", "a/6.txt")} | {f"b/{i}.json": f"{i}" * 30 for i in range(100, 130)}
    assert got == want
    one = Z.read_zips(spark, f"{folder}/more.zip")
    assert one.count() == 30 and one.select("archive").distinct().count() == 1
    spans = Z.ranges(f"{folder}/more.zip", 100)
    assert [s.a for s in spans[1:]] == [s.b for s in spans[:-1]] and (spans[0].a, spans[-1].b) == (0, 30) and len(spans) > 5
    assert Z.read_zips(spark, f"file://{tmp_path}/absent").count() == 0


def _empty_zip(io, zipfile):
    packed = io.BytesIO()
    zipfile.ZipFile(packed, "w").close()
    return packed.getvalue()
