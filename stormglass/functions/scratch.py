"""Tables that cut a plan's lineage, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which a cluster's machines share.

    A session on one machine (tests) gets a root of its own where that setting is missing; a cluster raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Write df to a new folder of the shared root and read it back: lineage ends there.

    The folder is added to keep, with which drop() deletes it after its last reader.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    if keep is not None:
        keep.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders that cut() wrote and nothing reads any more, through the file system that they are on."""
    jvm = spark.sparkContext._jvm
    while folders:
        path = jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
