"""Files of any store that Spark reads: looked up through its file systems, read by its readers."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tracewell-")


def shared_folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. Where none is set, a folder of this machine serves a local master; others raise."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or _own()).rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The same rows, written to and read from the shared folder, for tables that several others are made from."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _found(spark: SparkSession, path: str):
    """The file system of a path and the path, as the JVM has them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _found(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _found(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def read_small(spark: SparkSession, path: str) -> str:
    """A small text file whole."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, name) of the files of a folder that match a pattern; contents are not read."""
    from pyspark.sql import functions as F

    if not is_folder(spark, folder):
        return spark.createDataFrame([], "path string, name string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
