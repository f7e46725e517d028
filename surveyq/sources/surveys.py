"""Readers and writers of survey files, scores and run directories.

Paths are read by Spark alone, so any store works. Identity lives in directory
names: <dataset>_<model>/<id>.json and <dataset>_<model>_<kind><suffix>/<id>.json.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyq.functions import text as X
from surveyq.operators.summary import dedupe_models, numeric_then_text

REFERENCE = (
    "struct<idx:int,title:string,canonical_title:string,url:string,arxiv_id:string,semantic_scholar_id:string,doi:string,year:int,doc_id:bigint>"
)
GENERATION = (
    "id string, dataset_id string, model_id string, query string, text string, success boolean, "
    "meta struct<generated_at:string,model:string,latency_sec:double,cost_usd:double,error:string,category:string,"
    f"usage:struct<cost_usd:double,prompt:bigint,completion:bigint,reasoning:bigint>,references:array<{REFERENCE}>>, "
    "topic_id string, topic string, generated_text string, error string"
)
#: Kinds of score runs.
KINDS = ("factuality", "expert", "surge")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def directory(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files under path, one record each, with `stem` and `dir`; backups (_raw, _old) and files that don't parse are skipped."""
    full = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_corrupt_record", T.StringType())])
    df = (
        spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").json(path)
        .select("*", stem(F.col("_metadata.file_path")).alias("stem"), directory(F.col("_metadata.file_path")).alias("dir"))
    )
    return df.where(~F.col("stem").rlike("_(raw|old)$") & F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """Generations of the current and the former layout: old keys fill what the new ones leave empty."""
    return generations_of(read_records(spark, path, GENERATION))


def generations_of(raw: DataFrame) -> DataFrame:
    """Records of either layout, with the dir and stem they came from, as generations."""
    error = F.coalesce("error", "meta.error")
    return raw.select(
        F.coalesce("id", "topic_id").alias("id"), F.coalesce("dataset_id", F.substring_index("dir", "_", 1)).alias("dataset_id"),
        F.coalesce("model_id", F.regexp_extract("dir", "^[^_]*_(.*)$", 1)).alias("model_id"), F.coalesce("query", "topic").alias("query"),
        F.coalesce(X.empty_to_null("text"), F.col("generated_text"), F.lit("")).alias("text"),
        F.coalesce("success", error.isNull()).alias("success"), "meta", "stem", "dir",
    )


def read_scores(spark: SparkSession, path: str, scores: str) -> DataFrame:
    """Score files with (id, title, scores): either layout, without summaries and aggregates. scores: the struct's fields."""
    raw = read_records(spark, path, f"id string, topic_id string, query string, survey_title string, scores struct<{scores}>, judge_log array<string>")
    return raw.where(~F.col("stem").rlike("(?i)summary|aggregate")).select(
        F.coalesce("id", "topic_id", F.lit("?")).alias("id"), F.coalesce("query", "survey_title", F.lit("")).alias("title"), "scores", "judge_log", "stem", "dir"
    )


def ordered(df: DataFrame, column: str = "stem") -> DataFrame:
    """Numbers first by value, then the rest by text."""
    return df.orderBy(*numeric_then_text(F.col(column)))


def references(generations: DataFrame) -> DataFrame:
    """(survey_key, pos, idx, …): one row for each reference; idx falls back to the place from 1."""
    each = generations.select(
        F.concat_ws("/", "dataset_id", "model_id", "id").alias("survey_key"), F.posexplode("meta.references").alias("pos", "r")
    )
    return each.select("survey_key", "pos", "r.*").withColumn("idx", F.coalesce("idx", F.col("pos") + 1))


def discover_runs(spark: SparkSession, path: str) -> DataFrame:
    """(dir, dataset, model, kind, suffix, n_files, modified) of every run directory; only names and times are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select("path", "modificationTime")
    return name_runs(
        files.select(directory(F.col("path")).alias("dir"), stem(F.col("path")).alias("stem"), "modificationTime")
        .where(~F.col("stem").rlike("(?i)summary|aggregate"))
        .groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"), F.max("modificationTime").alias("modified"))
    )


def name_runs(dirs: DataFrame, column: str = "dir") -> DataFrame:
    """dirs with dataset, model, kind and suffix of names <dataset>_<model>_<kind><suffix>; other names go."""
    pattern = rf"(?i)^([^_]+)_(.+?)_({'|'.join(KINDS)})(.*)$"
    part = lambda k: F.regexp_extract(column, pattern, k)
    return dirs.where(F.col(column).rlike(pattern)).select("*", part(1).alias("dataset"), part(2).alias("model"), F.lower(part(3)).alias("kind"), part(4).alias("suffix"))


def runs_with_prefix(runs: DataFrame, prefix: str) -> DataFrame:
    """Runs whose name starts with prefix in any case, newest first."""
    return runs.where(F.lower("dir").startswith(prefix.lower())).orderBy(F.desc("modified"), "dir")


def datasets(dirs: DataFrame) -> DataFrame:
    """(dataset): what stands before the first _ of a directory."""
    return dirs.select(F.substring_index("dir", "_", 1).alias("dataset")).distinct()


def models(generation_dirs: DataFrame, runs: DataFrame) -> DataFrame:
    """(model): names of generations and runs, case differences once, in the generations' spelling."""
    a = generation_dirs.select(F.regexp_extract("dir", "^[^_]*_(.*)$", 1).alias("name"), F.lit(0).alias("priority"))
    return dedupe_models(a.unionByName(runs.select(F.col("model").alias("name"), F.lit(1).alias("priority"))).where("name <> ''"))


def run_id(*parts: Column) -> Column:
    """A variant's name: non-blank parts joined by _, safe for a path."""
    return F.concat_ws("_", *(X.slug(X.blank_to_null(p.cast("string"))) for p in parts))


def pending(todo: DataFrame, done: DataFrame, keys: list[str], valid: Column | None = None) -> DataFrame:
    """What still has to be computed: rows of todo without a valid result."""
    good = done if valid is None else done.where(valid)
    return todo.join(good.select(*keys).distinct(), keys, "left_anti")


#: When a stored result of each kind counts as done.
VALID = {
    "generation": lambda: F.coalesce(F.col("success"), F.lit(False)) & X.blank_to_null("text").isNotNull(),
    "diversity": lambda: F.col("diversity").isNotNull(),
}


def has_scores(names: list[str]) -> Column:
    """Done if every requested score is there."""
    done = F.lit(True)
    for n in names:
        done = done & F.col(f"scores.{n}").isNotNull()
    return done


def strip_variant(df: DataFrame, fields: tuple[str, ...] = ("supported", "alignscore", "evidence_refs", "alignscore_per_ref", "alignscore_best")) -> DataFrame:
    """A checkpoint without the fields that depend on the evidence variant."""
    return df.drop(*fields)


def write_surveys(df: DataFrame, path: str) -> None:
    """One JSON line for each survey, in a folder for each dataset and model."""
    df.write.mode("overwrite").partitionBy("dataset_id", "model_id").json(path)


def write_summary(df: DataFrame, path: str, fields: list[str]) -> None:
    """The listed columns, as far as df has them, as one CSV file with a header; a summary is a row for each survey."""
    df.select(*(F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic): non-blank lines that are no comment."""
    return spark.read.text(path).select(X.strip("value").alias("topic")).where((F.col("topic") != "") & ~F.col("topic").startswith("#"))


def human_surveys(spark: SparkSession, path: str, aliases: DataFrame) -> DataFrame:
    """(topic, title, text, outline, source): text files whose name, else folder, holds an alias; the first alias in order.

    aliases(alias, topic, ord) is a short, configured list that the driver reads; files without a topic have a null one.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.col("value").alias("text"), F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("source")
    )
    kept = files.where(F.lower("source").rlike(r"\.(md|txt|json)$") & ~file_name(F.col("source")).isin("README.md", "LICENSE", "NOTICE"))
    token = lambda c: F.translate(F.lower(c), "- ", "__")
    named = kept.select("*", stem(F.col("source")).alias("title"), token(stem(F.col("source"))).alias("a"), token(directory(F.col("source"))).alias("b"))
    listed = sorted((r["ord"], r["alias"], r["topic"]) for r in aliases.collect())
    hit = lambda c: F.coalesce(F.lit(None).cast("string"), *(F.when(F.col(c).contains(alias), topic) for _, alias, topic in listed))
    return named.select(F.coalesce(hit("a"), hit("b")).alias("topic"), "title", "text", X.outline("text", max_lines=30).alias("outline"), "source")


def baseline_generations(spark: SparkSession, path: str, queries: DataFrame, dataset: str, model: str) -> DataFrame:
    """<id>/<any>.json with a `survey` text as generations; queries(id, query) names them."""
    raw = read_records(spark, path, f"survey string, references array<{REFERENCE}>")
    one = raw.groupBy(F.col("dir").alias("id")).agg(F.min_by(F.struct("survey", "references"), "stem").alias("r"))
    return one.join(queries, "id", "left").select(
        "id", F.lit(dataset).alias("dataset_id"), F.lit(model).alias("model_id"), "query", F.coalesce("r.survey", F.lit("")).alias("text"),
        X.blank_to_null("r.survey").isNotNull().alias("success"), F.col("r.references").alias("references"),
    )


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content) of the .json members of .tar, .tar.gz, .tgz and .zip files; unsafe names are left out.

    An archive is one task: its format has to be read in order.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").where(F.lower("path").rlike(r"\.(tar|tar\.gz|tgz|zip)$"))

    def safe(name: str) -> bool:
        return name.lower().endswith(".json") and not name.startswith(("/", "\\")) and ".." not in name.replace("\\", "/").split("/")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"]):
                data, rows = io.BytesIO(bytes(content)), []
                if where.lower().endswith(".zip"):
                    with zipfile.ZipFile(data) as z:
                        rows = [(where, n, z.read(n).decode("utf-8", "replace")) for n in z.namelist() if safe(n)]
                else:
                    with tarfile.open(fileobj=data) as t:
                        rows = [(where, m.name, t.extractfile(m).read().decode("utf-8", "replace")) for m in t if m.isfile() and safe(m.name)]
                yield pd.DataFrame(rows, columns=["archive", "name", "content"])

    return files.mapInPandas(members, "archive string, name string, content string")


def archived_generations(spark: SparkSession, path: str) -> DataFrame:
    """Members of archives that are generations: JSON with an id and a text."""
    parsed = archive_members(spark, path).select("archive", "name", F.from_json("content", GENERATION).alias("g"))
    return parsed.select("archive", "name", "g.*").where(F.col("id").isNotNull() & F.col("text").isNotNull())


def new_members(members: DataFrame, existing: DataFrame) -> DataFrame:
    """Archive members whose name is not there yet."""
    return members.join(existing.select("name"), "name", "left_anti")
