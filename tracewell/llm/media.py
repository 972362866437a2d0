"""Media columns with content-defined chunking: store each payload chunk once, rebuild and verify.

A payload of 8-bit samples is stored as a WAV file of one channel. Chunks are
cut where a gear hash of the last 32 bytes has ``CUT_BITS`` leading zeros, so
equal passages are cut alike wherever they stand. A document's manifest is the
ordered list of its chunk digests; equal manifests are one medium.

Digests are counted over the distinct media first. Chunks that only one medium
has stay together and are compressed together; chunks that may be shared, by a
key filter of a fixed size, are stored by digest, each once, and find their
media in a join. So the bytes that move are those of media with shared chunks.
Store and manifests are tables in the shared folder. A medium is put back
together from what is read there, checked against the payload's own hash, and
read as samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import textscan
from tracewell.llm.shared import KeyFilter, kept
from tracewell.llm.textscan import Seen

UNIT = 64
LEAST, MOST, CUT_BITS = 256, 65536, 10
RATE = 8000
LEVEL = 9
_GEAR = np.random.default_rng(1453).integers(0, 2**32, 256, dtype=np.uint32)


def cut_marks(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end: the gear hash there has CUT_BITS leading zeros."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint32(step) if step < len(h) else 0
        h = h + older
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunk_ends(marks: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of data[start:end]; a mark counts from LEAST bytes on, at MOST bytes a chunk ends anyway."""
    out, at = [], start
    while end - at > LEAST:
        k = int(np.searchsorted(marks, at + LEAST))
        cut = min(int(marks[k]) if k < len(marks) else end, at + MOST, end)
        out.append(cut)
        at = cut
    if at < end or not out:
        out.append(end)
    return out


def padded(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of UNIT."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def wav_header(n: int, rate: int = RATE) -> bytes:
    """Header of a WAV file of n unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)


def wav_samples(media: bytes) -> bytes:
    """The samples of a WAV file of the above form."""
    riff, _, wave, fmt, size, kind, channels, _, _, _, bits, name, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, fmt, size, kind, channels, bits, name) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, 8, b"data") or len(media) != 44 + n:
        raise ValueError("not a WAV file of 8-bit samples of one channel")
    return media[44:]


def feature(samples: bytes) -> str:
    """Whole-number statistics of the samples: sum, energy about 128, crossings of 128, least, most, and an 8-bin histogram."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    high = x >= 128
    bins = np.bincount(x >> 5, minlength=8)
    return f"sum={x.sum()};energy={((x - 128) ** 2).sum()};crossings={(high[1:] != high[:-1]).sum()};min={x.min()};max={x.max()};bins={'/'.join(map(str, bins))}"


def _pieces(column: pa.Array) -> Iterator[tuple[int, bytes, int, list[tuple[bytes, int, int]]]]:
    """(row, payload, unpadded length, chunks as (digest, start, end)) of each text."""
    row = 0
    for _, _, data, offsets in textscan.chunks(column):
        raw = data.tobytes()
        for d in range(len(offsets) - 1):
            text = raw[offsets[d] : offsets[d + 1]]
            payload = padded(text)
            marks = cut_marks(np.frombuffer(payload, np.uint8)) if len(payload) > LEAST else np.zeros(0, int)
            at, chunks = 0, []
            for end in chunk_ends(marks, 0, len(payload)):
                chunks.append((hashlib.blake2b(payload[at:end], digest_size=16).digest(), at, end))
                at = end
            yield row, payload, len(text), chunks
            row += 1


MANIFEST = "doc_id long, n_bytes long, medium binary, chunks array<binary>, keys array<long>"


def _key(digest: bytes) -> int:
    """64 bits of a digest, to count and to filter by; a clash makes a chunk look shared, no more."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _medium(payload: bytes, chunks: list[tuple[bytes, int, int]]) -> bytes:
    return hashlib.blake2b(struct.pack("<Q", len(payload)) + b"".join(c[0] for c in chunks), digest_size=16).digest()


def manifests(docs: DataFrame) -> DataFrame:
    """Each document's medium, named by the digest of its ordered chunk list, that list, and the chunks' keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, medium, lists = [], [], []
            for _, payload, size, chunks in _pieces(b.column(1)):
                n.append(size)
                medium.append(_medium(payload, chunks))
                lists.append([c[0] for c in chunks])
            made = [pa.array(n, pa.int64()), pa.array(medium, pa.binary()), pa.array(lists, pa.list_(pa.binary())), pa.array([[_key(d) for d in x] for x in lists], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], ["doc_id", "n_bytes", "medium", "chunks", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(textscan.tidy(run), MANIFEST)


STORE = "medium binary, count int, want binary, seqs array<int>, sizes array<int>, digest binary, body binary"
_STORE_TYPES = [pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]


@dataclass
class Store:
    """Media as written: manifests, a row a document, and bodies.

    A body row either has a ``medium``, its hash and number of chunks, and the
    places, sizes and bytes of the chunks that it has alone; or the ``digest``
    and bytes of a chunk that may be shared. Rows of either kind may repeat.
    """

    listed: DataFrame
    bodies: DataFrame


def write_store(docs: DataFrame) -> Store:
    """Cut the payloads of docs (doc_id, text) into chunks and write them."""
    listed = kept(manifests(docs))
    # of each distinct medium, every key counts as often as it is listed
    media = listed.groupBy("medium").agg(F.first("keys").alias("keys"))
    shared = media.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    asked = KeyFilter.of(shared, "key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z, media, held = zstandard.ZstdCompressor(level=LEVEL), Seen(), Seen()
        rows: list[tuple] = []
        size = 0

        def told() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _STORE_TYPES, strict=True)], [x.split()[0] for x in STORE.split(", ")])
            rows.clear()
            return made

        for b in batches:
            for _, payload, _, chunks in _pieces(b.column(0)):
                medium = _medium(payload, chunks)
                if not media.first(medium):
                    continue
                maybe = asked.passes(np.array([_key(c[0]) for c in chunks], np.int64)).tolist()
                own = [k for k, m in enumerate(maybe) if not m]
                body = z.compress(b"".join(payload[chunks[k][1] : chunks[k][2]] for k in own))
                rows.append((medium, len(chunks), hashlib.sha256(payload).digest(), own, [chunks[k][2] - chunks[k][1] for k in own], None, body))
                size += len(body)
                for k, m in enumerate(maybe):
                    if m and held.first(chunks[k][0]):
                        rows.append((None, None, None, None, None, chunks[k][0], z.compress(payload[chunks[k][1] : chunks[k][2]])))
                        size += len(rows[-1][-1])
                if size > 8 << 20:
                    yield told()
                    size = 0
        if rows:
            yield told()

    return Store(listed, kept(docs.select(F.col("text").cast("string")).mapInArrow(textscan.tidy(run), STORE)))


def read_media(store: Store, schema: str = "media binary", show: Callable[[bytes], tuple] | None = None) -> DataFrame:
    """(medium, ...): each distinct medium's WAV file, put together and verified, or the columns that ``show`` makes of it.

    A medium whose chunks are all its own is done where it is stored; those
    with shared chunks meet them by digest, and then by medium.
    """
    show = show or (lambda media: (media,))
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.binary(), *types], strict=True)], ["medium", *names])

    def done(medium: bytes, count: int, want: bytes, parts: dict[int, bytes]) -> tuple:
        if set(parts) != set(range(count)):
            raise ValueError("a chunk is missing")
        payload = b"".join(parts[k] for k in range(count))
        media = wav_header(len(payload)) + payload
        if hashlib.sha256(wav_samples(media)).digest() != want:
            raise ValueError("a rebuilt payload differs from the one that was stored")
        return medium, *show(media)

    def cut(seqs: list[int], sizes: list[int], body: bytes) -> dict[int, bytes]:
        ends = np.cumsum([0, *sizes]).tolist()
        return {k: body[i:j] for k, i, j in zip(seqs, ends[:-1], ends[1:], strict=True)}

    def single(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            rows, size = [], 0
            for medium, count, want, seqs, sizes, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = zstandard.decompress(body) if seqs else b""
                rows.append(done(medium, count, want, cut(seqs, sizes, raw)))
                size += len(raw)
                if size > 8 << 20:
                    yield told(rows)
                    rows, size = [], 0
            if rows:
                yield told(rows)

    def several(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by medium; a body's single place is a shared chunk's."""
        import zstandard

        at, count, want, parts, rows, size = None, 0, b"", {}, [], 0
        for b in batches:
            for medium, n, sha, seqs, sizes, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if medium != at:
                    if at is not None:
                        rows.append(done(at, count, want, parts))
                        size += sum(map(len, parts.values()))
                    at, parts = medium, {}
                    if size > 8 << 20:
                        yield told(rows)
                        rows, size = [], 0
                raw = zstandard.decompress(body) if seqs else b""
                if n is not None:
                    count, want = n, sha
                    parts.update(cut(seqs, sizes, raw))
                else:
                    parts[seqs[0]] = raw
        if at is not None:
            rows.append(done(at, count, want, parts))
        if rows:
            yield told(rows)

    columns = ["medium", "count", "want", "seqs", "sizes", "body"]
    whole = store.bodies.filter("medium is not null").select(*columns)
    alone = whole.filter(F.size("seqs") == F.col("count"))
    apart = whole.filter(F.size("seqs") < F.col("count"))
    bodies = store.bodies.filter("digest is not null").groupBy("digest").agg(F.first("body").alias("body"))
    places = store.listed.groupBy("medium").agg(F.first("chunks").alias("chunks")).select("medium", F.posexplode("chunks").alias("seq", "digest"))
    found = places.join(bodies, "digest").select("medium", F.lit(None).cast("int").alias("count"), F.lit(None).cast("binary").alias("want"), F.array("seq").alias("seqs"), F.lit(None).cast("array<int>").alias("sizes"), "body")
    met = apart.union(found).repartition("medium").sortWithinPartitions("medium")
    out = "medium binary, " + schema
    return alone.mapInArrow(textscan.tidy(single), out).union(met.mapInArrow(textscan.tidy(several), out))


COLUMNS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(media: bytes) -> tuple:
    """COLUMNS of a WAV file."""
    samples = wav_samples(media)
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)


def media_files(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each document's verified WAV file; rows as in media_table."""
    store = write_store(docs)
    read = read_media(store).groupBy(F.col("medium").alias("built")).agg(F.first("media").alias("media"))
    return store.listed.select("doc_id", "medium").join(read, F.col("medium") == F.col("built")).select("doc_id", "media")


def media_table(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_bytes and what was read back from its stored medium.

    Null text is empty, a payload of 64 zero bytes; a null doc_id stays null;
    repeated rows each give a row; further columns are ignored; an empty table
    gives no rows. Equal texts have equal values.
    """
    store = write_store(docs)
    # the same medium may be stored by several tasks; both sides are read anew, so Spark may split a medium that many documents have
    read = read_media(store, COLUMNS, described)
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    read = kept(read.groupBy(F.col("medium").alias("built")).agg(*[F.min(c).alias(c) for c in names]))
    return store.listed.select("doc_id", "n_bytes", "medium").join(read, F.col("medium") == F.col("built")).select("doc_id", "n_bytes", *names)
