"""Token counts of documents in flat, unindexed token files, by a scan for separators.

A file is big-endian unsigned 16-bit ids end to end; each document ends with
the separator id. Files are cut into fixed blocks. numpy finds the separators
of each block at once; a document that spans blocks is stitched by a prefix
scan over one small row a block: tokens since the last separator are carried
along, and start anew behind each block that has one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm import textscan
from tracewell.llm.packing import word_ids

#: a free id whose two bytes are one UTF-8 character, which Spark's text writer can put between rows
SEPARATOR = 0xC280
BLOCK_TOKENS = 1 << 17
#: bytes of ids from which a run of documents is written, and how many runs go in a file: about 128 MB
RUN_BYTES, RUNS_A_FILE = 1 << 18, 512


def write_tokens(docs: DataFrame, tokenizer: str, path: str, separator: int = SEPARATOR) -> None:
    """Write the ids of each text of ``docs``, and the separator after each, as flat files under ``path``.

    Null text is empty: a separator alone. Rows that repeat are written each
    time; other columns are ignored; an empty table gives no documents.
    """
    end = separator.to_bytes(2, "big")

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer, ">u2")
        run, size = [], 0

        def told() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([end.join(run)], pa.binary())], ["ids"])
            run.clear()
            return made

        for b in batches:
            for _, _, texts in textscan.texts(b.column(0)):
                for ids in encoder.encode(texts):
                    run.append(ids)
                    size += len(ids) + 2
                    if size >= RUN_BYTES:
                        yield told()
                        size = 0
        if run:
            yield told()

    ids = docs.select(F.col("text").cast("string")).mapInArrow(textscan.tidy(runs, "words"), "ids binary")
    ids.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", end.decode("utf-8")).option("maxRecordsPerFile", RUNS_A_FILE).text(path)


BLOCKS = "file string, block long, tokens long, first long, last long, ends array<long>, before array<long>"


def scan_blocks(files: DataFrame, separator: int, block_tokens: int) -> DataFrame:
    """One row a block of ``files`` (path, content): its separators' first and last place, each one's, and that of the one before it, -1 for none."""
    size = 2 * block_tokens
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("content") / size).cast("int") - 1, F.lit(0)))
    cut = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.explode(parts.cast("array<long>")).alias("block"), "content")
    cut = cut.select("file", "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("data"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        for b in batches:
            tokens, first, last, ends, before = [], [], [], [], []
            for raw in b.column(2):
                data = raw.as_py()
                if len(data) % 2:
                    raise ValueError("a token file has an odd number of bytes")
                at = np.flatnonzero(np.frombuffer(data, ">u2") == separator)
                tokens.append(len(data) // 2)
                first.append(int(at[0]) if len(at) else -1)
                last.append(int(at[-1]) if len(at) else -1)
                ends.append(at)
                before.append(np.concatenate([[-1], at[:-1]]).astype(np.int64)[: len(at)])
            made = [pa.array(x, pa.int64()) for x in (tokens, first, last)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made, pa.array(ends, pa.list_(pa.int64())), pa.array(before, pa.list_(pa.int64()))], names)

    return cut.mapInArrow(textscan.tidy(run), BLOCKS)


def stitch(blocks: DataFrame) -> DataFrame:
    """One row a document: file, its number there, its first token, its count of tokens, and whether a separator ends it."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    has = F.col("first") >= 0
    rest = F.when(has, F.col("tokens") - F.col("last") - 1).otherwise(F.col("tokens"))
    b = blocks.withColumn("rest", rest).withColumn("segment", F.coalesce(F.sum(has.cast("long")).over(before), F.lit(0)))
    b = b.withColumn("opened", F.coalesce(F.last(F.when(has, F.col("rest")), True).over(before), F.lit(0)))
    b = b.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    b = b.withColumn("number", F.coalesce(F.sum(F.when(has, F.size("ends")).otherwise(0).cast("long")).over(before), F.lit(0)))
    inside = Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("carry", F.col("opened") + F.coalesce(F.sum("rest").over(inside), F.lit(0)))
    whole = Window.partitionBy("file").orderBy(F.desc("block"))
    b = b.withColumn("is_last", F.row_number().over(whole) == 1)
    done = b.select("file", "number", "base", "carry", F.posexplode(F.arrays_zip("ends", "before")).alias("k", "at"))
    # a block's first document has what the blocks before carry over
    more = F.when(F.col("k") == 0, F.col("carry")).otherwise(0)
    start, n_tokens = F.col("base") + F.col("at.before") + 1 - more, F.col("at.ends") - F.col("at.before") - 1 + more
    done = done.select("file", (F.col("number") + F.col("k")).alias("document"), start.alias("first_token"), n_tokens.alias("n_tokens"), F.lit(True).alias("ended"))
    left = F.when(has, F.col("rest")).otherwise(F.col("carry") + F.col("tokens"))
    number = F.col("number") + F.when(has, F.size("ends")).otherwise(0)
    open_end = b.filter("is_last").select("file", number.cast("long").alias("document"), (F.col("base") + F.col("tokens") - left).alias("first_token"), left.alias("n_tokens"), F.lit(False).alias("ended"))
    return done.union(open_end.filter("n_tokens > 0"))


def count_tokens(spark: SparkSession, path: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Token counts of every document of the flat files under ``path``.

    Documents do not span files. Two separators in a row are an empty document;
    tokens after the last separator are a document that no separator ends; an
    empty file has none.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return stitch(scan_blocks(files, separator, block_tokens))
