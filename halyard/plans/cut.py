"""Cutting lineage in iterative plans, and spreading rows over the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="halyard-cut-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows, kept in that folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, name: str) -> str:
    """Where the rows are written in that folder, for tasks that read them by themselves."""
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    path = path if "://" in path else path.replace("file:", "file://") if path.startswith("file:") else f"file://{path}"
    df.write.parquet(path)
    return path


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows in enough parts for all cores, by a hash of `by` where it is given: a small file is one split and a small
    shuffle one task, however much is made of each row after it."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *by)
