import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import packing
from tracewell.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def plain_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 2]


def check(pieces, texts):
    """Every id in exactly one piece, gapless sequences within the limits."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for doc, text in texts.items():
        ids, at = np.asarray(plain_ids(text), "<u4"), 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    pad = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and len(ps) <= 512
        pad += 0 if at & (at - 1) == 0 else 4096 - at
    return pad


def test_documents_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = packing.pack_documents(docs, tokenizer_path()).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(pieces, texts) < 0.01 * sum(p.length for p in pieces)


def test_odd_rows(spark):
    odd = {1: None, 2: "", 3: "a" * 9000, 4: "Ça <|endoftext|> Σ ΑΣ é \x1c x", 5: " \n ", 6: "it's we'll 123 ___"}
    df = spark.createDataFrame([(k, v, "en", 1) for k, v in odd.items()], "doc_id long, text string, start string, length int")
    check(packing.pack_documents(df, tokenizer_path()).collect(), odd)
    assert packing.pack_documents(df.limit(0), tokenizer_path()).count() == 0
    twice = df.filter("doc_id = 6").union(df.filter("doc_id = 6"))
    got = packing.pack_documents(twice, tokenizer_path()).collect()
    assert sum(p.length for p in got) == 2 * len(plain_ids(odd[6]))
    nul = spark.createDataFrame([(None, "x")], "doc_id long, text string")
    assert packing.pack_documents(nul, tokenizer_path()).first().doc_id is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 100)), max_size=60), st.booleans())
def test_limits_hold(items, cut):
    lim = packing.Limits(tokens=128, segments=4, loss=60, pool=5)
    rows = [(i, n, min(k, n)) for i, (n, k) in enumerate(items)]
    if not cut:
        rows = [(i, min(n, 128), min(k, 60)) for i, n, k in rows]
    # loss lies at the end of a row
    loss = lambda row, start, length: max(0, min(start + length, row[1]) - max(start, row[1] - row[2]))
    packer = packing.VectorPacker(lim, cut, 0, loss)
    placed = [p for r in rows for p in packer.add(r, r[1])] + list(packer.finish())
    seen, seqs = {}, {}
    for p in placed:
        seen.setdefault(p.item.row[0], []).append((p.item.start, p.item.length))
        s = seqs.setdefault(p.sequence, [0, 0, 0])
        assert p.offset == s[0]
        s[0], s[1], s[2] = s[0] + p.item.length, s[1] + 1, s[2] + p.item.loss
    assert all(s[0] <= 128 and s[1] <= 4 and s[2] <= 60 for s in seqs.values())
    for r in rows:
        at = 0
        for start, length in sorted(seen[r[0]]):
            assert start == at
            at += length
        assert at == r[1]
        assert cut or len(seen[r[0]]) == 1


def test_whole_items_must_fit():
    with pytest.raises(ValueError):
        list(packing.VectorPacker(packing.Limits(), False, 0).add("x", 5000))


def test_turns(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    lim = packing.Limits(tokens=2048, segments=8, loss=1024)
    got = packing.pack_turns(conv, tokenizer_path(), lim).collect()
    per = {}
    for p in got:
        s = per.setdefault(p.sequence_id, [0, 0, 0])
        s[0], s[1], s[2] = s[0] + p.length, s[1] + 1, s[2] + p.loss_tokens
    assert all(a <= 2048 and b <= 8 and c <= 1024 for a, b, c in per.values())
    want = {}
    for r in conv.collect():
        want[r.conv_id] = want.get(r.conv_id, 0) + len(plain_ids(r.text)) - 1
    have = {}
    for p in got:
        have[p.conv_id] = have.get(p.conv_id, 0) + p.length
    assert have == {k: v for k, v in want.items() if v}


def test_odd_turns(spark):
    long = "a very long turn " * 3000
    rows = [(1, 2, "assistant", "two"), (1, 1, "user", "one one"), (1, 1, "assistant", "one"), (1, None, "user", "before all"), (2, 1, "assistant", None), (3, 1, None, ""), (4, 1, "assistant", long), (4, 2, "user", "end"),
            (None, 1, "assistant", "alone"), (None, 1, "assistant", "alone"), (None, None, None, None), (5, 1, "user", "same"), (5, 1, "user", "same")]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "conv_id int, turn int, role string, text string, start long, loss long")
    lim = packing.Limits(tokens=512, segments=3, loss=300)
    got = packing.pack_turns(df, tokenizer_path(), lim).collect()
    n = lambda t: len(plain_ids(t)) - 1
    tokens, loss = {}, {}
    for p in got:
        tokens[p.conv_id] = tokens.get(p.conv_id, 0) + p.length
        loss[p.conv_id] = loss.get(p.conv_id, 0) + p.loss_tokens
    assert tokens == {1: n("two") + n("one one") + n("one") + n("before all"), 4: n(long) + n("end"), None: 2 * n("alone"), 5: 2 * n("same")}
    assert loss == {1: n("two") + n("one"), 4: n(long), None: 2 * n("alone"), 5: 0}
    assert sum(p.conv_id is None for p in got) == 2 and sum(p.conv_id == 4 for p in got) >= n(long) // 300
    per = {}
    for p in got:
        per.setdefault(p.sequence_id, []).append(p)
    assert all(sum(p.length for p in ps) <= 512 and sum(p.loss_tokens for p in ps) <= 300 and len(ps) <= 3 for ps in per.values())
    assert packing.pack_turns(df.limit(0), tokenizer_path()).count() == 0


def test_pieces_with_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack_documents(docs, tokenizer_path(), with_ids=True).collect()
    ids = {r.doc_id: plain_ids(r.text) for r in docs.collect()}
    assert all(list(r.ids) == ids[r.doc_id][r.start : r.start + r.length] and r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) for r in rows)
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))


@pytest.mark.parametrize("dtype", ["<u4", ">u2"])
def test_many_words_and_a_full_cache(dtype):
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdeinorstE.,é1"))
    texts = [" ".join("".join(letters[rng.integers(0, 16, rng.integers(1, 9))]) for _ in range(900)) for _ in range(60)]
    texts += ["<|x|> tok<|endoftext|>en. <| A. b! C? .. é. <|", "", " \n"]
    for most in (1_200_000, 3000):
        cache = packing.WordIdCache(tokenizer_path(), dtype, most=most)
        for at in range(0, len(texts), 7):
            part = texts[at : at + 7]
            for t, raw in zip(part, cache.encode([t.encode() for t in part]), strict=True):
                assert np.frombuffer(raw, dtype).tolist() == plain_ids(t)[:-1]
        assert most < 10_000 or cache.filled > 1 << 16


def test_ids_must_fit_their_type():
    with pytest.raises(ValueError):
        packing.WordIdCache(tokenizer_path(), "u1")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdehinorstxyzßàáäçèéêñóöøüÿÉÀœŒ'’.,!-0 \n"), max_size=40))
def test_words_of_letters(text):
    cache = packing.word_ids(tokenizer_path(), "<u4")
    assert cache.direct is not None
    assert np.frombuffer(cache.encode([text.encode()])[0], "<u4").tolist() == plain_ids(text)[:-1]
