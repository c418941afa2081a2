"""Tables that cut the lineage of long jobs, in the folder that the driver and every executor share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder, from spark.checkpoint.dir. Where it is unset a run on one machine gets a temporary one; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stepfree-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back with the same schema."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Removes tables of ``materialize`` that no later plan reads."""
    for df in tables:
        if df is not None:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
