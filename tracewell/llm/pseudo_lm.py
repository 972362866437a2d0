"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, scores documents.

Every token is predicted from the tokens on both sides of it. The vectors of
``SIDE`` tokens before and after, each weighted by its place, add up to a
hidden vector; the output is a two-level softmax, first over classes of
tokens, then within the class. A document's score is the sum of the log
conditional probabilities of its tokens, its pseudo-log-likelihood.

Tokens are words, hashed; the commonest hash buckets of the whole corpus have
ids of their own, the rest share ids. Training is data-parallel: every task
trains a copy on its share of the corpus, and Spark averages the copies by
the tokens they saw, in ``ROUNDS`` rounds that part the corpus by hash of its
texts: every document is trained on in one of them. So what is gathered grows with the
number of tasks, while the driver only ever holds one model.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import textscan

BUCKETS = 1 << 16
CLASSES, MEMBERS = 64, 64
VOCAB = CLASSES * MEMBERS
#: ids that the uncommon buckets share
SHARED = 512
#: one more vector for places outside the document
EDGE = VOCAB
WIDTH = 16
SIDE = 2
ROUNDS = 2
BATCH = 4096
#: tokens of a training step
STEP = 4096
#: logits within this bound need no shift before their exponentials
PLAIN = 80.0


@dataclass
class Model:
    inner: np.ndarray  # (VOCAB + 1, WIDTH) context vectors
    place: np.ndarray  # (2 * SIDE, WIDTH) weights of the places
    classes: np.ndarray  # (CLASSES, WIDTH + 1), the last column a bias
    outer: np.ndarray  # (CLASSES, MEMBERS, WIDTH + 1)

    @staticmethod
    def new(unigram: np.ndarray) -> Model:
        """Small random vectors; biases that give the unigram distribution of the ids."""
        rng = np.random.default_rng(11)
        p = (unigram + 0.5).reshape(CLASSES, MEMBERS)
        classes = (rng.normal(0, 0.05, (CLASSES, WIDTH + 1))).astype(np.float32)
        outer = (rng.normal(0, 0.05, (CLASSES, MEMBERS, WIDTH + 1))).astype(np.float32)
        classes[:, WIDTH] = np.log(p.sum(1) / p.sum())
        outer[:, :, WIDTH] = np.log(p / p.sum(1, keepdims=True))
        return Model(rng.normal(0, 0.1, (VOCAB + 1, WIDTH)).astype(np.float32), np.ones((2 * SIDE, WIDTH), np.float32), classes, outer)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.inner, self.place, self.classes, self.outer)])

    @staticmethod
    def of(flat: np.ndarray) -> Model:
        out, at = [], 0
        for shape in ((VOCAB + 1, WIDTH), (2 * SIDE, WIDTH), (CLASSES, WIDTH + 1), (CLASSES, MEMBERS, WIDTH + 1)):
            n = int(np.prod(shape))
            out.append(flat[at : at + n].reshape(shape).copy())
            at += n
        return Model(*out)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = np.empty((len(around), WIDTH + 1), np.float32)
        h[:, WIDTH] = 1
        np.einsum("njd,jd->nd", self.inner[around], self.place, out=h[:, :WIDTH])
        np.tanh(h[:, :WIDTH], out=h[:, :WIDTH])
        return h

    def by_class(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of the tokens by class, and where each class begins in it."""
        group = (ids // MEMBERS).astype(np.int16)
        order = np.argsort(group, kind="stable")
        return order, np.searchsorted(group[order], np.arange(CLASSES + 1))

    def logits(self, h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the classes, and of the members of each token's own class; the tokens are in order of their classes."""
        b = np.empty((len(h), MEMBERS), np.float32)
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            np.matmul(h[cuts[c] : cuts[c + 1]], self.outer[c].T, out=b[cuts[c] : cuts[c + 1]])
        return h @ self.classes.T, b

    def is_plain(self) -> bool:
        """Whether no logit can pass PLAIN: hidden values are within 1."""
        return max(np.abs(self.classes).sum(1).max(), np.abs(self.outer).sum(2).max()) < PLAIN

    def log_probs(self, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Log conditional probability of each token given those around it."""
        out, plain = np.empty(len(ids), np.float64), self.is_plain()
        for at in range(0, len(ids), BATCH):
            order, cuts = self.by_class(ids[at : at + BATCH])
            y = ids[at : at + BATCH][order]
            a, b = self.logits(self.hidden(around[at : at + BATCH][order]), cuts)
            n = np.arange(len(y))
            out[at + order] = a[n, y // MEMBERS] - _log_sum(a, plain) + (b[n, y % MEMBERS] - _log_sum(b, plain))
        return out

    def squares(self) -> list[np.ndarray]:
        """AdaGrad's sums of squared gradients before the first step."""
        return [np.full(x.shape, 1e-3, np.float32) for x in (self.inner, self.place, self.classes, self.outer)]

    def train(self, ids: np.ndarray, around: np.ndarray, rate: float = 0.3, sums: list[np.ndarray] | None = None) -> None:
        """One pass of AdaGrad over the tokens, in order; ``sums`` carries its state from call to call."""
        sums = sums or self.squares()
        for at in range(0, len(ids), STEP):
            order, cuts = self.by_class(ids[at : at + STEP])
            y, near = ids[at : at + STEP][order], around[at : at + STEP][order]
            n = len(y)
            h = self.hidden(near)
            plain, rows = self.is_plain(), np.arange(n)
            a, b = (_softmax(x, plain) for x in self.logits(h, cuts))
            a[rows, y // MEMBERS] -= 1
            b[rows, y % MEMBERS] -= 1
            g_classes = a.T @ h
            g_h = a @ self.classes
            g_outer = np.zeros_like(self.outer)
            for c in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[c], cuts[c + 1])
                np.matmul(b[own].T, h[own], out=g_outer[c])
                g_h[own] += b[own] @ self.outer[c]
            g_sum = g_h[:, :WIDTH] * (1 - h[:, :WIDTH] ** 2)
            g_place = np.einsum("njd,nd->jd", self.inner[near], g_sum)
            # one count over (vector, column) adds up what each context vector gets
            cells = (near * WIDTH)[:, :, None] + np.arange(WIDTH, dtype=near.dtype)
            g_inner = np.bincount(cells.ravel(), (g_sum[:, None, :] * self.place).ravel(), (VOCAB + 1) * WIDTH).astype(np.float32).reshape(VOCAB + 1, WIDTH)
            for x, g, s in zip((self.inner, self.place, self.classes, self.outer), (g_inner, g_place, g_classes, g_outer), sums, strict=True):
                g /= n**0.5
                s += g * g
                x -= rate * g / np.sqrt(s)


def _log_sum(a: np.ndarray, plain: bool) -> np.ndarray:
    """Log of each row's sum of exponentials, shifted by its largest one unless they are ``plain``."""
    if plain:
        return np.log(np.exp(a) @ np.ones(a.shape[1], np.float32))
    top = a.max(1)
    return top + np.log(np.exp(a - top[:, None]).sum(1))


def _softmax(a: np.ndarray, plain: bool) -> np.ndarray:
    e = np.exp(a if plain else a - a.max(1, keepdims=True), out=a)
    e /= (e @ np.ones(a.shape[1], np.float32))[:, None]
    return e


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, first): words with ASCII case folded."""
    words = textscan.scan(data, offsets)
    return (words.hashes(fold=True) % np.uint64(BUCKETS)).astype(np.int64), words.first


def windows(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ids around each token, SIDE before and SIDE after; EDGE outside its document."""
    n = len(ids)
    at = np.arange(n)
    lo = np.repeat(first[:-1], np.diff(first))
    hi = np.repeat(first[1:], np.diff(first))
    out = np.empty((n, 2 * SIDE), np.int32)
    for j, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        to = at + step
        ok = (to >= lo) & (to < hi)
        out[:, j] = np.where(ok, ids[np.clip(to, 0, max(n - 1, 0))] if n else 0, EDGE)
    return out


def vocabulary(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(id of each bucket, count of each id), from the words of all documents. The driver gets a row a bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, data, offsets in textscan.chunks(b.column(0)):
                counts += np.bincount(word_buckets(data, offsets)[0], minlength=BUCKETS)
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    got = docs.select(F.col("text").cast("string")).mapInArrow(textscan.tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[got["bucket"].to_numpy()] = got["n"].to_numpy()
    order = np.lexsort((np.arange(BUCKETS), -counts))
    ids = np.arange(BUCKETS, dtype=np.int64) % SHARED + VOCAB - SHARED
    own = order[: VOCAB - SHARED]
    ids[own] = np.arange(len(own))
    return ids, np.bincount(ids, counts, VOCAB)


def _parts(flat: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.array_split(flat, parts)


def fit(docs: DataFrame, rounds: int = ROUNDS, share: int | None = None, parts: int = 64) -> tuple[np.ndarray, Model]:
    """Fit on the corpus: (id of each bucket, model). Without a word the model stays at its start.

    Round k trains on the texts of hash class k of ``share``, by default as
    many classes as rounds, so that together the rounds see every document.
    """
    share = share or rounds
    ids_of, counts = vocabulary(docs)
    model = Model.new(counts)
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    for k in range(rounds):
        chosen = texts.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == k % share)
        start = model.flat()

        def run(batches: Iterable[pa.RecordBatch], start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            context = TaskContext.get()
            task = context.partitionId() if context else 0
            mine, seen = Model.of(start), 0
            sums = mine.squares()
            for b in batches:
                for _, _, data, offsets in textscan.chunks(b.column(0)):
                    buckets, first = word_buckets(data, offsets)
                    ids = ids_of[buckets]
                    mine.train(ids, windows(ids, first), sums=sums)
                    seen += len(ids)
            if seen:
                blobs = [x.tobytes() for x in _parts(mine.flat(), parts)]
                yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([task] * parts, pa.int64()), pa.array([seen] * parts, pa.int64()), pa.array(blobs, pa.binary())], ["part", "task", "seen", "weights"])

        def mean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come sorted by part and task, so sums are the same in every run."""
            sums: dict[int, list] = {}
            for b in batches:
                for part, _, seen, weights in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    x = np.frombuffer(weights, np.float32).astype(np.float64) * seen
                    held = sums.setdefault(part, [0.0, 0])
                    held[0], held[1] = held[0] + x, held[1] + seen
            if sums:
                blobs = [(x / n).astype(np.float32).tobytes() for x, n in sums.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(blobs, pa.binary())], ["part", "weights"])

        copies = chosen.mapInArrow(textscan.tidy(run), "part int, task long, seen long, weights binary")
        got = copies.repartition("part").sortWithinPartitions("part", "task").mapInArrow(textscan.tidy(mean), "part int, weights binary").toArrow()
        if got.num_rows:
            by = dict(zip(got["part"].to_pylist(), got["weights"].to_pylist(), strict=True))
            model = Model.of(np.concatenate([np.frombuffer(by[p], np.float32) for p in range(parts)]))
    return ids_of, model


def score(docs: DataFrame, ids_of: np.ndarray, model: Model) -> DataFrame:
    """Every column of ``docs``, then n_tokens, pseudo_log_likelihood and its mean a token.

    Null and wordless texts have 0 tokens, a sum of 0 and a null mean. A null
    doc_id, repeated rows and further columns pass through, but for columns of
    the new ones' names; an empty table gives no rows.
    """
    new = ["n_tokens", "pseudo_log_likelihood", "mean_log_probability"]
    kept = [c for c in docs.columns if c not in new]
    at = kept.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in textscan.chunks(b.column(at)):
                buckets, first = word_buckets(data, offsets)
                ids = ids_of[buckets]
                sums = np.concatenate([[0.0], np.cumsum(model.log_probs(ids, windows(ids, first)))])
                n = np.diff(first)
                total = np.where(n > 0, sums[first[1:]] - sums[first[:-1]], 0.0)
                mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns), pa.array(n.astype(np.int64)), pa.array(total), mean], [*kept, *new])

    schema = docs.select(*kept).schema.add("n_tokens", "long").add("pseudo_log_likelihood", "double").add("mean_log_probability", "double")
    return docs.select(*kept).mapInArrow(textscan.tidy(run), schema)
