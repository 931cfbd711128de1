"""Where results that several tasks share are kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode, where one machine runs all tasks, when the session names no folder.
OWN_FOLDER = "file:///tmp/tidemark-store"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only local mode may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = OWN_FOLDER
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read again, so that it is the same at every look and no lost executor takes any of it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
