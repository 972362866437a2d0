import hashlib
import re

import duckdb
from hypothesis import given
from hypothesis import strategies as st

from tracewell.llm import oracles, secret_scan, trigrams

SF = "/root/testdata/sf0.01"
PLAIN = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def plain(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in PLAIN["assign"].finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in PLAIN["access"].finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in PLAIN["hex"].finditer(text) if len(m[0]) >= 32]
    return sorted(out)


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def check(row, text):
    want = plain(text)
    assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[2] == k for s in want) for k in PLAIN]
    assert row.base_sha256 == hashlib.sha256(told(want).encode()).hexdigest()
    have = row.spans.split(",") if row.spans else []
    assert [s for s in have if s.split(":")[0] in PLAIN] == told(want).split(",")[: len(want)]


ODD = {
    1: None, 2: "", 3: "token: ab secret=abcdefgh1 x", 4: "token=token: abcdefgh", 5: "é😀 API_KEY = 'abcdefgh' AKIAAKIA0123456789 " + "0af" * 20,
    6: "AKIA1 AKIAABCDEFGHIJKL" + "K", 7: "password=" + "x" * 20 + "secret:yyyyyyyy", 8: "ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY-----",
    9: "f" * 31 + " " + "f" * 33 + "g" + "0" * 32, 10: "apikey:abcdefgh,tok\nen=abcdefghi", 11: "word " * 60000 + "token=abcdefgh1",
}


def test_against_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = secret_scan.report(docs).collect()
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 20
    for r in rows:
        check(r, texts[r.doc_id])


def test_odd_rows(spark):
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in ODD.items()] + [(3, ODD[3], "x", 1), (None, ODD[5], "x", 1)], "doc_id long, text string, rules string, start int")
    rows = secret_scan.report(df).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        check(r, ODD[5 if r.doc_id is None else r.doc_id])
    eight = next(r for r in rows if r.doc_id == 8)
    assert eight.spans == "github:0:40,pem:41:72"
    assert secret_scan.report(df.limit(0)).count() == 0
    clean = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert clean[7] == "[assign]:yyyyyyyy" or "xxxx" not in clean[7]
    assert clean[2] == "" and clean[10].startswith("[assign]")


def test_oracle_agrees(spark):
    df = spark.createDataFrame(list(ODD.items()), "doc_id long, text string")
    mine = sorted(map(tuple, secret_scan.report(df).collect()))
    con = duckdb.connect()
    pdf = df.toPandas()
    con.register("documents", pdf)
    assert sorted(con.sql(oracles.secret_scans()).fetchall()) == mine


def test_index_is_native(spark):
    plan = secret_scan.report(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


PATTERNS = ["ab(cd|e)fg", "x(foo|bar)?baz", "(abc|defg)+hij", "[ab]cde", "a{3}b", "(foo|b)ar[0-9]+qux", "(?i:AbC)d", r"a\.bcd?e", "abc|xyz"]


@given(st.sampled_from(PATTERNS).flatmap(lambda p: st.tuples(st.just(p), st.from_regex(p))))
def test_matches_satisfy_the_query(case):
    pattern, text = case
    assert trigrams.satisfied(trigrams.query_of(pattern), text)


def test_query_shapes():
    assert trigrams.query_of("[0-9a-f]+") == ()
    assert trigrams.query_of("abc|xyz") == ((frozenset({"abc"}), frozenset({"xyz"})),)
    assert not trigrams.satisfied(trigrams.query_of("abcd"), "abc bcx")
