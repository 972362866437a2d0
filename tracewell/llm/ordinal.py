"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's score is the sum of one shared weight vector over its hashed
text features. Ordered thresholds t1 < t2 < ... part the score into grades:
P(grade >= k) = sigmoid(score - t_k). The expected grade is the sum of these
tail probabilities; selection thresholds one of them.

Features, each present or absent: the distinct letter-and-digit words with
ASCII case folded, the first five bytes of longer ones, and binned shares of upper-case words, of symbols, of
words that repeat the word before, and of bars. The model is fitted with
numpy on a bounded sample of labelled rows and is broadcast as one vector.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import textscan

BUCKETS = 1 << 18
#: tail probability of the top grade from which a document is selected
KEEP = 0.5
STEM = 5
_SHAPES = 5
_BINS = 24

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>!@^~=_{}[]\\"]] = True


def _share(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, first): the distinct features of document d are ids[first[d]:first[d + 1]]."""
    docs = len(offsets) - 1
    spaced = np.where(_WORD[data], data, 32).astype(np.uint8)
    words = textscan.scan(spaced, offsets)
    h = words.hashes(fold=True)
    doc = np.repeat(np.arange(docs), np.diff(words.first))
    keys = [(doc.astype(np.int64) << 20) | (h % np.uint64(BUCKETS)).astype(np.int64)]
    # the first bytes of longer words stand for their stems
    long = np.flatnonzero(words.ends - words.starts > STEM)
    stems = textscan.Words(spaced, offsets, words.starts[long], words.starts[long] + STEM, words.first).hashes(fold=True)
    keys.append((doc[long].astype(np.int64) << 20) | (textscan.mix(stems + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64))

    count = np.maximum(np.diff(words.first), 1)
    size = np.maximum(np.diff(offsets), 1)
    letters = np.maximum(_share(_UPPER[data] | _LOWER[data], offsets), 1)
    again = np.zeros(len(h), bool)
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    shares = [
        _share(_UPPER[data], offsets) / letters,
        _share(_SYMBOL[data], offsets) / size,
        _share(again, words.first) / count,
        _share(data == 124, offsets) / count,
        np.log2(np.diff(words.first) + 1) / 24,
    ]
    rows = np.arange(docs, dtype=np.int64) << 20
    for k, share in enumerate(shares):
        # finer bins near zero
        level = np.minimum((np.sqrt(np.clip(share, 0, 1)) * _BINS).astype(np.int64), _BINS - 1)
        keys.append(rows | (BUCKETS + k * _BINS + level))
    found = np.unique(np.concatenate(keys))
    return (found & ((1 << 20) - 1)).astype(np.int32), np.searchsorted(found, np.arange(docs + 1, dtype=np.int64) << 20)


WIDTH = BUCKETS + _SHAPES * _BINS


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[ids], dtype=np.float64)])
        return sums[first[1:]] - sums[first[:-1]]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. , one row a document."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def fit(ids: np.ndarray, first: np.ndarray, grades: np.ndarray, levels: int, steps: int = 600, rate: float = 0.25, threshold_rate: float = 0.1, l1: float = 3e-4, l2: float = 1e-6, least: int = 8) -> Model:
    """Maximum likelihood of the cumulative-link model by AdaGrad over shuffled minibatches.

    Features of fewer than ``least`` rows keep weight 0. Epochs are as many
    as make ``steps`` minibatches, whatever the size of the sample.
    """
    rng = np.random.default_rng(7)
    n = len(first) - 1
    w, gw = np.zeros(WIDTH), np.full(WIDTH, 1e-6)
    shares = np.array([(grades >= k).mean() if n else 0.5 for k in range(1, levels)])
    shares = np.clip(np.minimum.accumulate(shares), 1e-3, 1 - 1e-3)
    t = np.maximum.accumulate(np.log((1 - shares) / shares) + 1e-3 * np.arange(levels - 1))
    gt = np.full(levels - 1, 1e-6)
    common = np.bincount(ids, minlength=WIDTH)[ids] >= least
    kept = np.concatenate([[0], np.cumsum(common)])
    ids, first = ids[common], kept[first]
    sizes = np.diff(first)
    for _ in range(max(1, round(steps * 256 / n)) if n else 0):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            rows = order[at : at + 256]
            take = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(sizes[rows])[:-1]]), sizes[rows]) + np.arange(sizes[rows].sum())
            cols, row = ids[take], np.repeat(np.arange(len(rows)), sizes[rows])
            s = np.bincount(row, w[cols], len(rows))
            y = grades[rows]
            wide = np.concatenate([[-np.inf], t, [np.inf]])
            up = 1 / (1 + np.exp(-np.clip(wide[y + 1] - s, -50, 50)))
            lo = 1 / (1 + np.exp(-np.clip(wide[y] - s, -50, 50)))
            up[y == levels - 1], lo[y == 0] = 1.0, 0.0
            p = np.maximum(up - lo, 1e-9)
            du, dl = up * (1 - up) / p, lo * (1 - lo) / p
            ds = du - dl  # derivative of the loss in the score
            g = np.bincount(cols, ds[row], WIDTH) / len(rows)
            used = np.unique(cols)
            g = g[used] + l2 * w[used]
            gw[used] += g * g
            step = rate / np.sqrt(gw[used])
            moved = w[used] - step * g
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            dt = np.zeros(levels - 1)
            np.add.at(dt, y[y < levels - 1], -du[y < levels - 1])
            np.add.at(dt, y[y > 0] - 1, dl[y > 0])
            dt /= len(rows)
            gt += dt * dt
            t = np.maximum.accumulate(t - threshold_rate * dt / np.sqrt(gt))
    return Model(w.astype(np.float32), t)


def grade_of(quality: str = "quality", toxic: str = "toxic"):
    """Grade 0: poor; 1: well made but toxic; 2: well made and clean. Null ratings give null."""
    return F.when(F.col(quality) < 1, 0).when(F.col(toxic) > 0, 1).when(F.col(quality).isNotNull() & F.col(toxic).isNotNull(), 2)


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, grade): at most ``most`` rated ids, chosen by hash; the lowest rating of an id counts."""
    graded = labels.select(F.col("doc_id").alias("label_id"), grade_of().alias("grade")).dropna()
    one = graded.groupBy("label_id").agg(F.min("grade").alias("grade"))
    return one.orderBy(F.xxhash64("label_id"), "label_id").limit(most)


def fit_on(docs: DataFrame, labels: DataFrame, most: int = 12_000, levels: int = 3) -> Model:
    """Fit on at most ``most`` labelled documents; the ids are few enough to broadcast, as ``most`` bounds them.

    Rows that repeat an id and a text count once, and of more documents than
    ``most``, as ids can repeat with other texts, the first by hash are taken,
    so every run fits the same model.
    """
    sample = F.broadcast(labelled_sample(labels, most))
    rated = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("label_id")).select("text", F.col("grade").cast("int"), F.xxhash64("doc_id", "text").alias("at"))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in textscan.chunks(b.column(0)):
                ids, first = features(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([lists, b.column(1)[lo:hi], b.column(2)[lo:hi]], ["ids", "grade", "at"])

    found = rated.mapInArrow(textscan.tidy(extract), "ids array<int>, grade int, at long")
    got = found.groupBy("at").agg(F.first("ids").alias("ids"), F.min("grade").alias("grade")).orderBy("at").limit(most).toArrow()
    lists = got["ids"].combine_chunks()
    ids = np.concatenate([np.asarray(x.values, np.int32) for x in lists]) if len(lists) else np.zeros(0, np.int32)
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return fit(ids, first, np.asarray(got["grade"], np.int64), levels)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every column of ``docs``, then expected_grade and one tail probability a grade, p_1, p_2, ...

    Null text is empty and gets the score of an empty text; a null doc_id,
    repeated rows and further columns pass through; names that clash with the
    new columns are replaced; an empty table gives no rows.
    """
    new = ["expected_grade", *(f"p_{k + 1}" for k in range(len(model.thresholds)))]
    kept = [c for c in docs.columns if c not in new]
    at = kept.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in textscan.chunks(b.column(at)):
                tails = model.tails(model.scores(*features(data, offsets)))
                made = [pa.array(tails.sum(1)), *(pa.array(np.ascontiguousarray(x)) for x in tails.T)]
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns), *made], [*kept, *new])

    schema = docs.select(*kept).schema
    for c in new:
        schema = schema.add(c, "double")
    return docs.select(*kept).mapInArrow(textscan.tidy(run), schema)
