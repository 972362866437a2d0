from collections import Counter

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.llm.test_packing import plain_ids
from tracewell.llm import queries, token_files

SF = "/root/testdata/sf0.01"
SEP = token_files.SEPARATOR


def plain(ids):
    out, start = [], 0
    for i, t in enumerate(ids):
        if t == SEP:
            out.append((len(out), start, i - start, True))
            start = i + 1
    if start < len(ids):
        out.append((len(out), start, len(ids) - start, False))
    return out


def test_documents(spark):
    rows = queries.op6_token_counts(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert Counter(r.n_tokens for r in rows) == Counter(len(plain_ids(d.text)) - 1 for d in docs)
    assert all(r.ended for r in rows)
    for name in {r.file for r in rows}:
        at = 0
        for k, r in enumerate(sorted((r for r in rows if r.file == name), key=lambda r: r.document)):
            assert (r.document, r.first_token) == (k, at)
            at += r.n_tokens + 1


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([1, 2, SEP]), max_size=40), min_size=1, max_size=3), st.integers(1, 9))
def test_blocks_are_stitched(spark, tmp_path, files, block):
    where = tmp_path / f"{np.random.default_rng().integers(1 << 60)}"
    where.mkdir()
    for k, ids in enumerate(files):
        (where / f"part-{k}").write_bytes(np.asarray(ids, ">u2").tobytes())
    got = sorted(map(tuple, token_files.count_tokens(spark, str(where), SEP, block).collect()))
    assert got == sorted((f"part-{k}", *r) for k, ids in enumerate(files) for r in plain(ids))


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), ("", 2), ("word " * 5000, 3), ("é \u0080 x", 4)], "text string, block long").coalesce(1)
    token_files.write_tokens(df, queries.tokenizer_path(), str(tmp_path / "t"))
    got = sorted(r.n_tokens for r in token_files.count_tokens(spark, str(tmp_path / "t"), block_tokens=64).collect())
    assert got == sorted(len(plain_ids(r.text)) - 1 for r in df.collect())
    token_files.write_tokens(df.limit(0), queries.tokenizer_path(), str(tmp_path / "e"))
    assert token_files.count_tokens(spark, str(tmp_path / "e")).count() == 0
