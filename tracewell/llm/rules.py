"""Quality rules: base statistics of words and lines, and a hashed n-gram likelihood ratio.

Two multinomials over hashed byte n-grams are counted: one of a trusted
target, one of the whole raw corpus. A document's score is the mean, over its
n-grams, of log(p_target / p_raw): the length-normalised log-likelihood
ratio. A document is kept when its score reaches a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import ordinal, textscan
from tracewell.llm.shared import KeyFilter

BUCKETS = 1 << 16
GRAMS = (3, 4)
#: mean log-likelihood ratio, in nats an n-gram, from which a document is kept
THRESHOLD = -0.2

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base statistics of documents that lie end to end."""
    docs = len(offsets) - 1
    words = textscan.scan(data, offsets)
    n_words = np.diff(words.first)
    points = ~textscan.SPACE[data] & ((data & 0xC0) != 0x80)
    h = words.hashes()
    return {
        "n_words": n_words,
        "word_chars": _per_doc(points, offsets),
        "n_symbols": _per_doc(_SYMBOLS[data], offsets),
        "n_dup_lines": _dup_lines(data, offsets, docs),
        "n_repeat_words": _repeat_words(h, words.first, docs),
    }


def _dup_lines(data: np.ndarray, offsets: np.ndarray, docs: int) -> np.ndarray:
    breaks = np.flatnonzero(data == 10)
    # lines end at a break or at a document's end; ends at one place part at most one line with a word
    ends = np.union1d(breaks, offsets[1:])
    starts = np.concatenate([[0], np.where(np.isin(ends[:-1], breaks), ends[:-1] + 1, ends[:-1])]) if len(ends) else ends
    starts = np.minimum(starts, ends)
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~textscan.SPACE[data], out=inside[1:])
    worded = inside[ends] > inside[starts]
    starts, ends = starts[worded], ends[worded]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    h = textscan.Words(data, offsets, starts, ends, np.zeros(0)).hashes()
    key = textscan.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=docs) - np.bincount(doc[at], minlength=docs)


def _repeat_words(h: np.ndarray, first: np.ndarray, docs: int, n: int = 8) -> np.ndarray:
    out = np.zeros(docs, np.int64)
    w = textscan.windows(h, n)
    if not len(w):
        return out
    doc = np.repeat(np.arange(docs), np.diff(first))
    at = np.flatnonzero(doc[: len(w)] == doc[n - 1 :])
    key = textscan.mix(w[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = at[twice]
    if len(hit):
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + n, -1)
        out += np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=docs)
    return out


def gram_ids(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of the n-gram at every byte, and whether it lies within one document."""
    size = np.diff(offsets)
    left = np.repeat(offsets[1:], size) - np.arange(len(data))  # bytes from here to the document's end
    x = data.astype(np.uint32)
    for n in GRAMS:
        if len(data) < n:
            continue
        code = x[: len(x) - n + 1].copy()
        for k in range(1, n):
            code = code * np.uint32(257) + x[k : len(x) - n + 1 + k]
        code *= np.uint32(0x9E3779B1)
        yield (code >> np.uint32(16)).astype(np.int64), left[: len(code)] >= n


def gram_counts(texts: DataFrame, name: str) -> DataFrame:
    """(bucket, ``name``): each task's counts of the n-grams of ``texts``, a row for each bucket it met."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, data, offsets in textscan.chunks(b.column(0)):
                for ids, inside in gram_ids(data, offsets):
                    counts += np.bincount(ids[inside], minlength=BUCKETS)
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", name])

    return texts.mapInArrow(textscan.tidy(count), f"bucket long, {name} long")


def ratio_table(docs: DataFrame, labels: DataFrame | None) -> np.ndarray:
    """log(p_target / p_raw) of every bucket.

    The raw corpus is all of ``docs``; the target is every document whose id
    is rated of the top grade, or all of them without ``labels``. Trusted ids
    meet their texts in a merge join at every size, as both grow with the
    corpus; a key filter of a fixed size keeps most other texts from moving.
    Counts are summed by bucket in Spark; the driver gets one row a bucket.
    Null ids and ratings count for nothing; of several ratings of an id the
    lowest counts; documents that repeat count each time.
    """
    counts = gram_counts(docs.select("text"), "raw").withColumn("target", F.lit(0))
    if labels is not None:
        trusted = labels.select(F.col("doc_id").alias("label_id"), ordinal.grade_of().alias("grade")).dropna().groupBy("label_id").agg(F.min("grade").alias("grade")).filter("grade = 2")
        asked = KeyFilter.of(trusted.select(F.xxhash64(F.col("label_id").cast("long")).alias("key")), "key")
        _, maybe = asked.split(docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("long")).alias("key")), "key")
        texts = maybe.join(trusted.hint("merge"), F.col("doc_id") == F.col("label_id")).select("text")
        counts = counts.union(gram_counts(texts, "target").select("bucket", F.lit(0), "target"))
    else:
        counts = counts.withColumn("target", F.col("raw"))
    sums = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[np.asarray(sums["bucket"])] = np.asarray(sums["raw"])
    target[np.asarray(sums["bucket"])] = np.asarray(sums["target"])
    if not target.sum():
        return np.zeros(BUCKETS)
    # add-one smoothing of the target towards the raw distribution
    p_raw = (raw + 1) / (raw.sum() + BUCKETS)
    p_target = (target + BUCKETS * p_raw) / (target.sum() + BUCKETS)
    return np.log(p_target / p_raw)


def ratios(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean log ratio of each document's n-grams; 0 without any."""
    docs = len(offsets) - 1
    total, count = np.zeros(docs), np.zeros(docs)
    for ids, inside in gram_ids(data, offsets):
        cuts = np.minimum(offsets, len(ids))
        sums = np.concatenate([[0.0], np.cumsum(np.where(inside, table[ids], 0.0))])
        total += sums[cuts[1:]] - sums[cuts[:-1]]
        count += _per_doc(inside, cuts)
    return total / np.maximum(count, 1)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, table: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Every column of ``docs``, then the base statistics, llr, base_failed and kept.

    Null text has no words and fails the base. A null doc_id, repeated rows
    and further columns pass through; names that clash with the new columns
    are replaced; an empty table gives no rows.
    """
    new = [*COLUMNS, "llr", "base_failed", "kept"]
    kept = [c for c in docs.columns if c not in new]
    at = kept.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in textscan.chunks(b.column(at)):
                base = base_counts(data, offsets)
                llr = ratios(table, data, offsets)
                failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
                made = [*(pa.array(base[c].astype(np.int64)) for c in COLUMNS), pa.array(llr), pa.array(failed), pa.array(~failed & (llr >= threshold))]
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns), *made], [*kept, *new])

    schema = docs.select(*kept).schema
    for c in new:
        schema = schema.add(c, "long" if c in COLUMNS else "double" if c == "llr" else "boolean")
    return docs.select(*kept).mapInArrow(textscan.tidy(run), schema)
