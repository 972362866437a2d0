import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import media

SF = "/root/testdata/sf0.01"


def check(rows, texts):
    feature = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        pay = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(pay))
        assert r.payload_sha256 == hashlib.sha256(pay).hexdigest()
        assert r.tail_crc32 == zlib.crc32(pay[-64:])
        stored = media.wav_header(len(pay)) + pay
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == media.feature(pay) == feature.setdefault(pay, r.feature)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = media.media_table(docs).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    long = "".join(map(chr, rng.integers(40, 900, 300_000)))
    odd = {1: None, 2: "", 3: "x" * 64, 4: "é" * 33, 5: long, 6: "start " + long, 7: "z" * 400_000, None: "y"}
    df = spark.createDataFrame([(k, v, 1) for k, v in odd.items()] + [(5, long, 1)], "doc_id long, text string, medium int")
    rows = media.media_table(df).collect()
    assert len(rows) == len(odd) + 1
    check(rows, odd)
    assert media.media_table(df.limit(0)).count() == 0


def test_chunks_are_shared(spark):
    rng = np.random.default_rng(6)
    long = "".join(map(chr, rng.integers(40, 120, 200_000)))
    df = spark.createDataFrame([(1, long), (2, long[:100_000] + "!" + long[100_000:])], "doc_id long, text string")
    store = media.write_store(df)
    manifests = {r.doc_id: r.chunks for r in store.listed.collect()}
    bodies = store.bodies.collect()
    shared = {r.digest for r in bodies if r.digest is not None}
    assert len(shared & set(manifests[1]) & set(manifests[2])) > 0.95 * len(manifests[1])
    assert sum(len(r.seqs) for r in bodies if r.medium is not None) < 0.1 * len(manifests[1])


def test_media_files_are_the_stored_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = media.media_files(docs).collect()
    assert len(rows) == len(texts) and all(r.media == media.wav_header(len(media.padded(texts[r.doc_id]))) + media.padded(texts[r.doc_id]) for r in rows)
    cut = [len(r.chunks) for r in media.manifests(docs).collect()]
    assert np.mean([n > 1 for n in cut]) > 0.5


def test_a_lost_chunk_is_told(spark):
    long = "".join(map(chr, np.random.default_rng(7).integers(40, 120, 20_000)))
    df = spark.createDataFrame([(1, long), (2, "other words " + long)], "doc_id long, text string")
    store = media.write_store(df)
    broken = media.Store(store.listed, store.bodies.filter("digest is null"))
    with pytest.raises(Exception, match="chunk is missing"):
        media.read_media(broken).collect()


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 10**6), st.integers(0, 40_000))
def test_cuts_depend_on_content_alone(head, seed, n):
    body = np.random.default_rng(seed).integers(0, 256, n, dtype=np.uint8)
    data = np.concatenate([np.frombuffer(head, np.uint8), body])
    marks, own = media.cut_marks(data), media.cut_marks(body)
    assert (marks[marks > len(head) + 32] - len(head)).tolist() == own[own > 32].tolist()
    ends = media.chunk_ends(own, 0, n)
    assert ends[-1] == n and ends == sorted(set(ends)) and max(np.diff([0, *ends])) <= media.MOST
