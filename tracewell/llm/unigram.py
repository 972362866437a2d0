"""Unigram segmentation in the manner of SentencePiece: Viterbi over a double-array trie of scored pieces.

Spaces become the marker U+2581 and one is put in front. A character that no
piece covers falls back to its UTF-8 bytes as byte pieces. As no piece holds
a marker behind another character, the best path of a text is that of its
units, runs of markers with what follows. Units are learned once each: all new
units of a batch walk the trie together in numpy, one start position at a
time; long ones go one by one.

The vocabulary file gives pieces by rank; the score of rank r is its
log-probability under Zipf's law, in steps of 1/1024, so that sums are exact.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import textscan

MARK = "▁".encode()
#: the cost of a character without a piece, below the lowest score
UNKNOWN_COST = 10.0
LONG = 192


class DoubleArray:
    """A trie of byte strings: from state s, byte c leads to t = base[s] + c if check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in keys.items():
            at = 0
            for c in key:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    value.append(-1)
                at = children[at][c]
            value[at] = v
        size = 2 * len(children) + 1024
        base, check, term = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        place, free = {0: 0}, 1
        todo = [0]
        for node in todo:
            kids = sorted(children[node])
            if not kids:
                continue
            while check[free] >= 0:
                free += 1
            slot, tried = free, 0
            while True:
                tried += 1
                b = slot - kids[0]
                need = b + kids[-1] + 1
                if need > len(check):
                    more = need - len(check) + 4096
                    base, check, term = base + [0] * more, check + [-1] * more, term + [-1] * more
                if b > 0 and all(check[b + c] < 0 for c in kids):
                    break
                slot += 1
                while slot < len(check) and check[slot] >= 0:
                    slot += 1
            if tried > 48:  # too full to search again
                free = slot
            s = place[node]
            base[s] = b
            for c in kids:
                child = children[node][c]
                check[b + c], term[b + c] = s, value[child]
                place[child] = b + c
                todo.append(child)
        # 256 more places, so that a step from any state stays within the arrays
        self.base, self.check, self.term = (np.array(x + [y] * 256, np.int32) for x, y in ((base, 0), (check, -1), (term, -1)))
        self.depth = max(map(len, keys), default=0)

    @functools.cached_property
    def lists(self) -> tuple[list[int], list[int], list[int]]:
        return self.base.tolist(), self.check.tolist(), self.term.tolist()

    def find(self, key: bytes) -> int:
        at = 0
        for c in key:
            t = int(self.base[at]) + c
            if self.check[t] != at:
                return -1
            at = t
        return int(self.term[at])


@dataclass
class Pieces:
    """Pieces with scores; kind 1 is normal, 6 a byte, others take no part. ``shown`` decodes an id."""

    shown: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    trie: DoubleArray

    @staticmethod
    def of(rows: list[tuple[str, float, int]]) -> Pieces:
        normal = {p.encode(): i for i, (p, _, kind) in enumerate(rows) if kind == 1}
        if any(MARK in p for p in _trimmed(normal)):
            raise ValueError("a piece holds a marker behind another character")
        byte_ids = np.full(256, -1)
        shown = []
        for i, (p, _, kind) in enumerate(rows):
            if kind == 6:
                byte_ids[int(p[3:5], 16)] = i
            shown.append(bytes([int(p[3:5], 16)]) if kind == 6 else p.encode().replace(MARK, b" ") if kind == 1 else b"")
        if (byte_ids < 0).any():
            raise ValueError("a byte has no piece")
        return Pieces(shown, np.array([s for _, s, _ in rows]), byte_ids, DoubleArray(normal))

    @property
    def unknown(self) -> float:
        return float(min(self.scores[i] for i in self._normal)) - UNKNOWN_COST

    @functools.cached_property
    def _normal(self) -> np.ndarray:
        t = self.trie.term
        return t[t >= 0]


def _trimmed(keys: Iterable[bytes]) -> Iterator[bytes]:
    for k in keys:
        while k.startswith(MARK):
            k = k[len(MARK) :]
        yield k


def zipf_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a vocabulary file, with Zipf log-probabilities by rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kinds = [6 if sp.is_byte(i) else 2 if sp.is_unknown(i) else 3 if sp.is_control(i) else 1 for i in range(n)]
    total = math.log(sum(1 / (r + 1) for r in range(kinds.count(1))))
    rows, rank = [], 0
    for i in range(n):
        score = 0.0
        if kinds[i] == 1:
            score = round(1024 * (-math.log(rank + 1) - total)) / 1024
            rank += 1
        rows.append((sp.id_to_piece(i), score, kinds[i]))
    return rows


class Segmenter:
    """Encodes and decodes; remembers the ids of at most ``most`` units."""

    #: a line break is in no piece of several characters, so it parts units too
    UNITS = re.compile(rb"\x20+[^\x20\n]*|\n|[^\x20\n]+")

    def __init__(self, pieces: Pieces, most: int = 1_000_000):
        self.p, self.most = pieces, most
        self.known: dict[bytes, bytes] = {}
        if any(b"\n" in s and len(s) > 1 for s in pieces.shown):
            self.UNITS = re.compile(rb"\x20+[^\x20]*|[^\x20]+")
        self.low = pieces.unknown

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit bytes."""
        out = []
        for at in range(0, len(texts), 256):
            split = [self.UNITS.findall(b" " + t) if t else [] for t in texts[at : at + 256]]
            self._learn(set().union(*split))
            get = self.known.__getitem__
            out += [b"".join(map(get, units)) for units in split]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD; the marker in front goes."""
        raw = b"".join(map(self.p.shown.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")

    def _learn(self, units: set[bytes]) -> None:
        new = units.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, units
        words = sorted(new, key=len)
        marked = [w.replace(b" ", MARK) for w in words]
        short = [k for k, m in enumerate(marked) if len(m) <= LONG]
        for at in range(0, len(short), 8192):
            part = short[at : at + 8192]
            for k, ids in zip(part, self._viterbi([marked[k] for k in part]), strict=True):
                self.known[words[k]] = ids
        for k, m in enumerate(marked):
            if len(m) > LONG:
                self.known[words[k]] = self._viterbi_one(m)

    def _bytes(self, ids: list[int], spans: list[tuple[int, int]], raw: bytes) -> bytes:
        """Ids as bytes; -1 is replaced by the byte pieces of its span."""
        if -1 not in ids:
            return np.array(ids, "<u4").tobytes()
        flat: list[int] = []
        for i, (a, b) in zip(ids, spans, strict=True):
            flat += [i] if i >= 0 else self.p.byte_ids[list(raw[a:b])].tolist()
        return np.array(flat, "<u4").tobytes()

    def _viterbi(self, words: list[bytes]) -> Iterator[bytes]:
        """Best paths of many short units at once."""
        n, width = len(words), max(map(len, words), default=0)
        if not n:
            return
        data = np.zeros((n, width + 4), np.int32)
        sizes = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), np.uint8)
        rows = np.repeat(np.arange(n), sizes)
        data[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        best = np.full((n, width + 4), -np.inf)
        best[:, 0] = 0
        came = np.full((n, width + 4), -1, np.int32)
        piece = np.full((n, width + 4), -1, np.int32)
        base, check, term, scores = self.p.trie.base, self.p.trie.check, self.p.trie.term, self.p.scores
        for start in range(width):
            lead = data[:, start]
            row = np.flatnonzero((start < sizes) & ((lead & 0xC0) != 0x80) & (best[:, start] > -np.inf))
            if not len(row):
                continue
            lead = lead[row]
            wide = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            wide = np.minimum(wide, sizes[row] - start)
            whole = np.zeros(n, bool)  # whether the character alone is a piece
            size_of = np.zeros(n, np.int64)
            size_of[row] = wide
            at, state = row, np.zeros(len(row), np.int32)
            for k in range(self.p.trie.depth):
                go = start + k < sizes[at]
                at, state = at[go], state[go]
                to = base[state] + data[at, start + k]
                ok = check[to] == state
                at, state = at[ok], to[ok]
                if not len(at):
                    break
                ids = term[state]
                hit = ids >= 0
                if hit.any():
                    r, i = at[hit], ids[hit]
                    whole[r[size_of[r] == k + 1]] = True
                    score = best[r, start] + scores[i]
                    better = score > best[r, start + k + 1]
                    r, i, score = r[better], i[better], score[better]
                    best[r, start + k + 1], came[r, start + k + 1], piece[r, start + k + 1] = score, start, i
            lost = ~whole[row]
            r, end = row[lost], start + wide[lost]
            score = best[r, start] + self.low
            better = score > best[r, end]
            r, end = r[better], end[better]
            best[r, end], came[r, end], piece[r, end] = score[better], start, -1
        for k, w in enumerate(words):
            end, ids, spans, c, p = len(w), [], [], came[k].tolist(), piece[k].tolist()
            while end:
                ids.append(p[end])
                spans.append((c[end], end))
                end = c[end]
            yield self._bytes(ids[::-1], spans[::-1], w)

    def _viterbi_one(self, w: bytes) -> bytes:
        """Best path of one long unit."""
        base, check, term = self.p.trie.lists
        scores, n = self.p.scores.tolist(), len(w)
        best, came, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            lead = w[start]
            if lead & 0xC0 == 0x80 or best[start] == -math.inf:
                continue
            wide = min(1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4, n - start)
            whole, state, here = False, 0, best[start]
            for end in range(start + 1, n + 1):
                to = base[state] + w[end - 1]
                if check[to] != state:
                    break
                state, i = to, term[to]
                if i >= 0:
                    whole |= end - start == wide
                    if here + scores[i] > best[end]:
                        best[end], came[end], piece[end] = here + scores[i], start, i
            end = start + wide
            if not whole and here + self.low > best[end]:
                best[end], came[end], piece[end] = here + self.low, start, -1
        end, ids, spans = n, [], []
        while end:
            ids.append(piece[end])
            spans.append((came[end], end))
            end = came[end]
        return self._bytes(ids[::-1], spans[::-1], w)


_made: dict[str, Segmenter] = textscan.CACHES.setdefault("pieces", {})


def segmenter(path: str) -> Segmenter:
    """One a worker process and vocabulary file."""
    if path not in _made:
        _made[path] = Segmenter(Pieces.of(zipf_pieces(path)))
    return _made[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Every column of ``docs``, then ``ids``, an array of the text's ids.

    Null text gives a null array, an empty one an empty array. A null doc_id,
    repeated rows and further columns pass through, but for a column of the
    new one's name; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c != "ids"]
    at = kept.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segmenter(path)
        for b in batches:
            for lo, hi, texts in textscan.texts(b.column(at)):
                part = b.slice(lo, hi - lo)
                known = part.column(at).is_valid().to_pylist()
                ids = [np.frombuffer(i, "<u4").astype(np.int32) if there else None for there, i in zip(known, seg.encode(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*kept, "ids"])

    return docs.select(*kept).mapInArrow(textscan.tidy(run, "pieces"), docs.select(*kept).schema.add("ids", T.ArrayType(T.IntegerType())))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Every column of ``tokens``, then ``decoded``, the text of its ``ids``; null for null."""
    kept = [c for c in tokens.columns if c != "decoded"]
    at = kept.index("ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segmenter(path)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = [None if x.as_py() is None else seg.decode(np.asarray(x.values)) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*kept, "decoded"])

    return tokens.select(*kept).mapInArrow(textscan.tidy(run, "pieces"), tokens.select(*kept).schema.add("decoded", "string"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32 and whether decoding gives the text back; null text is empty.

    A null doc_id stays null; repeated rows each give a row; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segmenter(path)
        is_byte = np.zeros(len(seg.p.shown), bool)
        is_byte[seg.p.byte_ids] = True
        for b in batches:
            for lo, hi, part in textscan.texts(b.column(1)):
                n, fallen, crc, same = [], [], [], []
                for t, raw in zip(part, seg.encode(part), strict=True):
                    ids = np.frombuffer(raw, "<u4")
                    n.append(len(ids))
                    fallen.append(int(is_byte[ids].sum()))
                    crc.append(zlib.crc32(raw))
                    same.append(seg.decode(ids).encode() == t)
                made = [pa.array(x, pa.int64()) for x in (n, fallen, crc)]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], *made, pa.array(same)], ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(textscan.tidy(run, "pieces"), "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean")
