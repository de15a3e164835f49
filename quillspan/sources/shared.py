"""Intermediate results as tables in a folder that all executors share: computed once, and read again after an executor is lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir. Where it names none: in local mode a folder of this machine, else one beside the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        local = master == "local" or master.startswith("local[")
        named = "file://" + tempfile.mkdtemp(prefix="quillspan-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back. The table stays until the folder's owner deletes it or `drop` is given the result's path."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
