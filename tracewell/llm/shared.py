"""Tables in the folder that driver and executors share, and key filters of a fixed size."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import textscan

#: thin rows that go in a file, where a table's size is known
FILE_ROWS = 50_000


@functools.cache
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="shared-")


def shared_path(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a folder of this machine serves a local master; others raise."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows, written to and read from the shared folder: lineage ends here.

    ``rows`` tells about how many thin rows there are: they go in few files,
    more as they grow, whatever the number of shuffle partitions. In a local
    folder each file takes two processes, forked from the JVM to set its
    permissions; until such a one is another program, it counts with all of
    the JVM's memory.
    """
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables from kept() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@dataclass
class KeyFilter:
    """A bit set that has the bit of each of a set of 64-bit hashes. Its size is fixed; as it fills, more others pass."""

    BITS = 1 << 25
    words: np.ndarray

    @staticmethod
    def of(keys: DataFrame, column: str) -> KeyFilter:
        """The filter of a column of hashes; the driver gets BITS / 64 rows at most."""
        bit = F.col(column).bitwiseAND(F.lit(KeyFilter.BITS - 1))
        rows = keys.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("m"))
        got = rows.groupBy("word").agg(F.bit_or("m").alias("m")).toArrow()
        out = np.zeros(KeyFilter.BITS // 64, np.int64)
        out[got["word"].to_numpy()] = got["m"].to_numpy()
        return KeyFilter(out.view(np.uint64))

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Whether the bit of each hash is set."""
        bit = keys.view(np.uint64) & np.uint64(self.BITS - 1)
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0

    def split(self, rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """(rows whose hash is not in the set, rows whose hash may be)."""
        at = rows.columns.index(column)

        def keep(passing: bool):
            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield b.filter(pa.array(self.passes(b.column(at).to_numpy()) == passing))

            return rows.mapInArrow(textscan.tidy(run), rows.schema)

        return keep(False), keep(True)
