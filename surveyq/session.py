"""Sessions for local use; a cluster's own session is taken as it is."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "surveyq", **conf: str) -> SparkSession:
    """A local[cpus] session with UTC times and adaptive plans.

    Shuffle partitions follow the cores here; on a cluster AQE coalesces from
    whatever the session is configured with.
    """
    n = os.cpu_count() if cpus == "*" else int(cpus)
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("SURVEYQ_DRIVER_MEMORY", "12g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under spark.checkpoint.dir, which driver and executors share; under a temporary folder where all of Spark is one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}"
    return f"{where.rstrip('/')}/surveyq-{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df as a table under the shared folder: cuts lineage and is computed once. options are the writer's."""
    path = scratch_folder(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_files(spark: SparkSession, folder: str, files: dict[str, bytes]) -> str:
    """Write a few small files through Hadoop's file system, wherever the folder lies; returns the folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, content in files.items():
        out = system.create(path(f"{folder}/{name}"))
        out.write(bytearray(content))
        out.close()
    return folder
