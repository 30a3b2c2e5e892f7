"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only a session whose driver is its one executor may do without that setting; a temporary folder is made and set there. On a cluster
    that would be a folder which other machines can't see, so its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="orgweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder, which must be there, when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so that later jobs survive lost executors without recomputing it, and so that a
    costly stage runs once. The files go when the application ends, or before that by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orgweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more, such as those of earlier rounds."""
    for df in frames:
        spark, path = df.sparkSession, df.written_to
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
