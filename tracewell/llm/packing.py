"""Packing of examples into training sequences by dot-product vector bin packing.

A sequence has three capacities at once: tokens, segments, and tokens that
bear loss. An item takes a vector of them. The open sequence takes, again and
again, the item that fits and whose demand has the largest dot product with
the capacity left, both taken relative to the sequence's limits (Panigrahy et
al., "Heuristics for Vector Bin Packing"). Items of equal size class are kept
in queues, so a choice looks at the classes, not at the items.

Where items may be cut, what no item fills is filled with the head of another
one, and the last sequences of a task are cut to powers of two, which need no
padding. Packing runs within each task over its own rows: nothing is shuffled
and memory holds at most ``pool`` items, however many rows a task has.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm import textscan

END_ID = 2


@dataclass(frozen=True)
class Limits:
    """Capacities of one sequence and the number of items that wait at most."""

    tokens: int = 4096
    segments: int = 512
    loss: int = 4096
    pool: int = 8192


@dataclass
class Item:
    """A run of tokens; loss counts those of them that bear loss."""

    row: object
    start: int
    length: int
    loss: int


@dataclass
class Placed:
    item: Item
    sequence: int
    offset: int


class VectorPacker:
    """Packs items one stream at a time; ``cut`` says whether items may be cut.

    Uncuttable items longer than a sequence are an error. In a cut item, loss
    is taken to lie evenly over its tokens; callers that need exact loss counts
    give ``loss_of(row, start, length)``.
    """

    #: width of a size class, in tokens
    STEP = 64

    def __init__(self, limits: Limits, cut: bool, first_sequence: int, loss_of: Callable[[object, int, int], int] | None = None):
        self.limits, self.cut, self.next = limits, cut, first_sequence
        self.loss_of = loss_of or (lambda row, start, length: length)
        self.classes: dict[tuple[int, int], deque[Item]] = {}
        self.order: list[tuple[int, int]] = []  # the classes' keys, ascending
        self.waiting = 0
        self.tokens = 0
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], float)

    def add(self, row: object, length: int) -> Iterator[Placed]:
        """Queue a document's tokens; give what became placed."""
        start, lim = 0, self.limits
        while self.cut and length - start >= lim.tokens:
            size = self._fit(row, start, lim.tokens, lim.tokens, lim.loss)
            if size < lim.tokens:
                break
            yield Placed(Item(row, start, size, self.loss_of(row, start, size)), self._open(), 0)
            start += size
        while self.cut and length - start > lim.tokens:  # loss is the tighter limit here
            size = self._fit(row, start, lim.tokens, lim.tokens, lim.loss)
            self._queue(Item(row, start, size, self.loss_of(row, start, size)))
            start += size
        if length > start:
            item = Item(row, start, length - start, self.loss_of(row, start, length - start))
            if not self.cut and (item.length > lim.tokens or item.loss > lim.loss):
                raise ValueError(f"an item of {item.length} tokens, {item.loss} of them with loss, exceeds a sequence's limits")
            if item.loss > lim.loss:
                head = self._fit(row, start, item.length, lim.tokens, lim.loss)
                self._queue(Item(row, start, head, self.loss_of(row, start, head)))
                item = Item(row, start + head, item.length - head, self.loss_of(row, start + head, item.length - head))
            self._queue(item)
        while self.waiting > lim.pool:
            yield from self._sequence()

    def finish(self) -> Iterator[Placed]:
        """Place everything that still waits."""
        while self.waiting and (not self.cut or self.tokens >= self.limits.tokens):
            yield from self._sequence()
        if not self.waiting:
            return
        # less than one sequence is left: powers of two, largest first
        left = deque(x for k in sorted(self.classes, reverse=True) for x in self.classes[k])
        while left:
            total = sum(x.length for x in left)
            size = min(1 << (total.bit_length() - 1), self.limits.tokens)
            sequence, offset, segments, loss = self._open(), 0, 0, 0
            while offset < size and segments < self.limits.segments and left:
                x = left.popleft()
                take = self._fit(x.row, x.start, x.length, size - offset, self.limits.loss - loss)
                if not take:
                    left.appendleft(x)
                    break
                head, rest = self._split(x, take)
                yield Placed(head, sequence, offset)
                offset, segments, loss = offset + take, segments + 1, loss + head.loss
                if rest:
                    left.appendleft(rest)
        self.classes, self.order, self.waiting, self.tokens = {}, [], 0, 0

    def _open(self) -> int:
        self.next += 1
        return self.next - 1

    def _queue(self, x: Item) -> None:
        key = (x.length // self.STEP, x.loss // self.STEP)
        if key not in self.classes:
            self.classes[key] = deque()
            insort(self.order, key)
        self.classes[key].append(x)
        self.waiting += 1
        self.tokens += x.length

    def _take(self, key: tuple[int, int]) -> Item:
        queue = self.classes[key]
        x = queue.popleft()
        if not queue:
            del self.classes[key]
            del self.order[bisect_left(self.order, key)]
        self.waiting -= 1
        self.tokens -= x.length
        return x

    def _fit(self, row: object, start: int, length: int, tokens: int, loss: int) -> int:
        """The longest head of the item, up to length, within both limits."""
        lo, hi = 0, min(length, tokens)
        if hi <= 0 or self.loss_of(row, start, hi) <= loss:
            return max(hi, 0)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.loss_of(row, start, mid) <= loss else (lo, mid - 1)
        return lo

    def _split(self, x: Item, take: int) -> tuple[Item, Item | None]:
        if take == x.length:
            return x, None
        head = Item(x.row, x.start, take, self.loss_of(x.row, x.start, take))
        tail = Item(x.row, x.start + take, x.length - take, self.loss_of(x.row, x.start + take, x.length - take))
        return head, tail

    def _sequence(self) -> Iterator[Placed]:
        lim, sequence = self.limits, self._open()
        tokens, segments, loss, offset = lim.tokens, lim.segments, lim.loss, 0
        while tokens and segments and self.waiting:
            best, score = None, -1.0
            a, b, c = tokens / lim.tokens**2, segments / lim.segments**2, loss / lim.loss**2
            # from the longest class that may fit; no item has more loss than tokens, which bounds what shorter ones score
            for at in range(bisect_left(self.order, (tokens // self.STEP + 1,)) - 1, -1, -1):
                key = self.order[at]
                if (a + c) * (key[0] + 1) * self.STEP + b < score:
                    break
                x = self.classes[key][0]
                if x.length <= tokens and x.loss <= loss and (s := a * x.length + b + c * x.loss) > score:
                    best, score = key, s
            if best is None:
                break
            x = self._take(best)
            yield Placed(x, sequence, offset)
            offset, tokens, segments, loss = offset + x.length, tokens - x.length, segments - 1, loss - x.loss
        if self.cut and tokens and segments and self.waiting:
            x = self._take(self.order[-1])
            take = self._fit(x.row, x.start, x.length, tokens, loss)
            head, rest = self._split(x, take) if take else (None, x)
            if head:
                yield Placed(head, sequence, offset)
            if rest:
                self._queue(rest)


class WordIdCache:
    """Token ids of words, by a public tokenizer.

    For tokenizers that drop white space, the ids of a text are those of its
    white-space separated words, end to end. Words are told apart by 64-bit
    hashes. Unknown ones are encoded in one call, parted by a special token.
    The cache holds ``most`` words; when full it starts anew, so its memory is
    bounded.
    """

    def __init__(self, path: str, dtype: str, separator: str = "<|endoftext|>", most: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > np.iinfo(dtype).max + 1:
            raise ValueError(f"the tokenizer has ids beyond {dtype}")
        self.separator, self.dtype, self.most = separator, np.dtype(dtype), most
        self.kind = self.dtype.newbyteorder("=")  # numpy's functions return native bytes whatever they are given
        self.separator_id = self.tokenizer.token_to_id(separator)
        self.marks = {ord(c): self._ids(c) for c in ".,;:!?"}
        self.direct = self._merges_alone(path)
        self._forget()

    def _forget(self) -> None:
        #: hashes of the known words, ascending, and where their ids lie in the pool
        self.names, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.filled = np.zeros(1 << 16, self.kind), 0

    #: UTF-8 of lower-case letters of ASCII and Latin-1
    LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

    def _merges_alone(self, path: str):
        """The tokenizer's merges without what comes before them, if they mark the ends of words and bytes are spelled as characters."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = {x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])}
        steps = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        suffix = spec["model"].get("end_of_word_suffix")
        if not (spec["model"]["type"] == "BPE" and suffix and kinds <= {"NFC", "Replace", "Lowercase"} and steps == ["Split", "ByteLevel"]):
            return None
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        # byte-level spelling: bytes that print stand for themselves, the others for characters from 256 on, in order
        prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.spelling = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in prints)}
        del self.spelling[32]  # stays between words
        direct = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None}))
        words = ["the", "über", "ça", "ñandú", "straße", "x", "éèêëïîœ"[:6]]
        spelled = [w.encode().decode("latin-1").translate(self.spelling) for w in words]
        same = direct.encode(spelled, is_pretokenized=True, add_special_tokens=False).ids == self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids
        return direct if same else None

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _put(self, ids: np.ndarray) -> int:
        """Append to the pool; the place of the first."""
        at = self.filled
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(at + len(ids), self.kind)])
        self.pool[at : at + len(ids)] = ids
        self.filled += len(ids)
        return at

    def _text_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(places, sizes) of the ids of words of any kind, parted by the separator, through the whole tokenizer."""
        starts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            text = self.separator.join([w.decode("utf-8", "replace") for w in part])
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(ids == self.separator_id)
            if len(cuts) != len(part) - 1:
                raise ValueError("the separator was not kept apart")
            first = np.concatenate([[0], cuts + 1])
            sizes.append(np.concatenate([cuts, [len(ids)]]) - first)
            starts.append(self._put(ids) + first)
        return np.concatenate(starts), np.concatenate(sizes)

    def _letter_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of lower-case Latin letters alone: what comes before the merges leaves them whole."""
        starts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            joined = b" ".join(part).decode("latin-1")
            if not joined.isascii():
                joined = joined.translate(self.spelling)
            ids = np.asarray(self.direct.encode_batch_fast([joined.split(" ")], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("a word's end was not marked")
            first = np.concatenate([[0], ends[:-1]])
            sizes.append(ends - first)
            starts.append(self._put(ids.astype(self.kind)) + first)
        return np.concatenate(starts), np.concatenate(sizes)

    def _find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the known words, whether each hash is known)."""
        if not len(self.names):
            return np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return at, self.names[at] == names

    def _know(self, names: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Add words that are not known, by ascending hash."""
        at = np.searchsorted(self.names, names)
        self.names, self.starts, self.sizes = (np.insert(old, at, new) for old, new in ((self.names, names), (self.starts, starts), (self.sizes, sizes)))

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray) -> None:
        """Make the ids of unknown words known: data[starts:ends], each once.

        Most have the ids of their stem, the word in lower case, without one
        closing mark after an ASCII letter, and then those of the mark.
        """
        low = _LOWER[data]
        marked = (ends - starts > 1) & _MARK[data[ends - 1]] & _LETTER[data[np.maximum(ends - 2, 0)]]
        special = np.zeros(len(starts), bool)
        if len(opens := np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))):  # what may be a special token
            special = np.searchsorted(opens, starts) < np.searchsorted(opens, ends - 1)
        stem_ends = ends - marked
        stems = textscan.Words(low, np.zeros(1, np.int64), starts, stem_ends, starts).hashes()
        plain = np.flatnonzero(~special)
        fresh, first = np.unique(stems[plain], return_index=True)
        new = ~self._find(fresh)[1]
        fresh, rows = fresh[new], plain[first[new]]
        raw = low.tobytes()
        words = [raw[i:j] for i, j in zip(starts[rows].tolist(), stem_ends[rows].tolist(), strict=True)]
        kind = np.array([0 if w.isalpha() else 1 if self.LETTERS.fullmatch(w) else 2 for w in words], np.int8) if self.direct is not None else np.full(len(words), 2, np.int8)
        put, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for k in range(3):
            at = np.flatnonzero(kind == k)
            if len(at):
                put[at], size[at] = (self._text_ids if k == 2 else self._letter_ids)([words[i] for i in at.tolist()])
        self._know(fresh, put, size)
        # words that are their stems are known by now
        other = np.flatnonzero(~special & (names != stems))
        row, _ = self._find(stems[other])
        put, size = self.starts[row], self.sizes[row].astype(np.int64)
        for c, ids in self.marks.items():
            at = np.flatnonzero(marked[other] & (data[ends[other] - 1] == c))
            if len(at):
                n = size[at] + len(ids)
                made = self.pool[_runs(put[at], n) % len(self.pool)]
                close = np.cumsum(n)
                for k in range(len(ids)):
                    made[close - len(ids) + k] = ids[k]
                put[at], size[at] = self._put(made) + close - n, n
        odd = np.flatnonzero(special)
        ids = [self._ids(data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace")) for k in odd.tolist()]
        names = np.concatenate([names[other], names[odd]])
        put, size = np.concatenate([put, np.array([self._put(x) for x in ids], np.int64)]), np.concatenate([size, np.array([len(x) for x in ids], np.int64)])
        order = np.argsort(names)
        order = order[~self._find(names[order])[1]]
        self._know(names[order], put[order], size[order])

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): ids[first[d] : first[d + 1]] are those of document d, of texts that lie end to end."""
        words = textscan.scan(data, offsets)
        names, at, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        known = self._find(names)[1]
        if len(self.names) + 2 * (len(names) - known.sum()) > self.most:
            self._forget()
            known[:] = False
        if not known.all():
            new = at[~known]
            self._learn(data, words.starts[new], words.ends[new], names[~known])
        row, _ = self._find(names)
        sizes = self.sizes[row][back]
        ids = self.pool[_runs(self.starts[row][back], sizes)].astype(self.dtype, copy=False)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[words.first]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, end to end, as bytes."""
        offsets = np.cumsum([0, *map(len, texts)])
        ids, first = self.encode_block(np.frombuffer(b"".join(texts), np.uint8), offsets)
        return [ids[i:j].tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... of runs of the given sizes, one after the other."""
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


_caches: dict[tuple[str, str], WordIdCache] = textscan.CACHES.setdefault("words", {})


def word_ids(path: str, dtype: str) -> WordIdCache:
    """One cache a worker process and tokenizer."""
    if (path, dtype) not in _caches:
        _caches[path, dtype] = WordIdCache(path, dtype)
    return _caches[path, dtype]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) and pack every token into sequences, cutting freely.

    One row a piece, ``with_ids`` with its ids. Every token but the first of a
    document bears loss, as nothing before it predicts the first. A null or
    empty text is the end id alone; a null doc_id stays null; repeated rows are
    packed once each; extra columns are ignored; an empty table gives no rows.
    Sequence ids are unique: the task's number, times 2**32, plus a running
    number. A task that runs again on the same split gives the same pieces.
    """
    schema = PIECES + ", ids array<int>" if with_ids else PIECES
    names = [x.split()[0] for x in schema.split(", ")]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        task = context.partitionId() if context else 0
        encoder = word_ids(tokenizer, "<u4")
        end = np.asarray([end_id], "<u4").tobytes()
        packer = VectorPacker(limits, True, task << 32, lambda row, start, length: length - (start == 0))
        rows: list[tuple] = []
        told: list[bytes] = []

        def keep(placed: Iterable[Placed]) -> None:
            for p in placed:
                doc, ids = p.item.row
                raw = ids[4 * p.item.start : 4 * (p.item.start + p.item.length)]
                rows.append((doc, p.item.start, p.item.length, zlib.crc32(raw), len(ids) // 4, p.sequence, p.offset, p.item.loss))
                if with_ids:
                    told.append(raw)

        def batch() -> pa.RecordBatch:
            arrays = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            if with_ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in told)])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(told), "<i4"))))
            made = pa.RecordBatch.from_arrays(arrays, names)
            rows.clear()
            told.clear()
            return made

        for b in batches:
            for lo, hi, data, offsets in textscan.chunks(b.column(1)):
                ids, first = encoder.encode_block(data, offsets)
                for doc, i, j in zip(b.column(0)[lo:hi].to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    raw = ids[i:j].tobytes() + end
                    keep(packer.add((doc, raw), len(raw) // 4))
                if len(rows) >= 4096:
                    yield batch()
        keep(packer.finish())
        if rows:
            yield batch()

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(textscan.tidy(pack, "words"), schema)


def pack_turns(conversations: DataFrame, tokenizer: str, limits: Limits = Limits(), loss_role: str = "assistant") -> DataFrame:
    """Pack whole conversations of instruction data without cutting them.

    Input: conv_id, turn, role, text. Only tokens of ``loss_role`` bear loss.
    A conversation is one segment; one that exceeds a limit alone gets
    sequences of its own, cut at its limits. Returns conv_id, start, length,
    loss_tokens, sequence_id and offset a piece, none of a conversation without
    tokens. Turns come by number, null first; turns of one number, and rows
    that repeat, come by whether they bear loss, then by text. Null text is
    empty and a null role bears no loss. A row with a null conv_id is a
    conversation of its own. Other columns are ignored; an empty table gives no
    rows. A conversation streams through one task, which holds its tokens'
    marks, a byte each.
    """
    from pyspark.sql import functions as F

    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("loss"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    # rows without a conversation are dealt by their text, so that no task gets them all
    dealt = turns.repartition(F.when(F.col("conv_id").isNull(), F.xxhash64("text", "turn")).otherwise(F.xxhash64("conv_id"))).sortWithinPartitions("conv_id", "turn", "loss", "text")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 32
        encoder = word_ids(tokenizer, "<u4")

        def loss_of(row: tuple, start: int, length: int) -> int:
            return int(np.count_nonzero(row[1][start : start + length]))

        packer, rows = VectorPacker(limits, False, first, loss_of), []
        wide = VectorPacker(limits, True, first + (1 << 31), loss_of)
        names = ["conv_id", "start", "length", "loss_tokens", "sequence_id", "offset"]

        def keep(placed: Iterable[Placed]) -> None:
            rows.extend((p.item.row[0], p.item.start, p.item.length, p.item.loss, p.sequence, p.offset) for p in placed)

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)
            rows.clear()
            return made

        def add(conv: int | None, held: list[np.ndarray]) -> None:
            marks = np.concatenate(held)
            fits = len(marks) <= limits.tokens and np.count_nonzero(marks) <= limits.loss
            keep((packer if fits else wide).add((conv, marks), len(marks)))

        at, held = None, []
        for b in batches:
            for lo, hi, texts in textscan.texts(b.column(3)):
                convs, loss = b.column(0)[lo:hi].to_pylist(), b.column(2)[lo:hi].to_pylist()
                for conv, bears, ids in zip(convs, loss, encoder.encode(texts), strict=True):
                    if held and (conv != at or conv is None):
                        add(at, held)
                        held = []
                    at = conv
                    held.append(np.full(len(ids) // 4, bears, bool))
                if len(rows) >= 4096:
                    yield batch()
        if held:
            add(at, held)
        keep(packer.finish())
        keep(wide.finish())
        if rows:
            yield batch()

    return dealt.mapInArrow(textscan.tidy(pack, "words"), "conv_id long, start long, length long, loss_tokens long, sequence_id long, offset long")
