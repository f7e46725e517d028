"""Configuration files: YAML where the yaml module is there, JSON always."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def read_config(spark: SparkSession, path: str) -> dict:
    """The settings in a small file at any path that Spark reads; a file that is missing or no mapping is an error."""
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    try:
        import yaml
    except ImportError:
        found = json.loads(text)
    else:
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no settings")
    return found
