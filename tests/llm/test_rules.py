import re
from collections import Counter

import numpy as np

from tracewell.llm import rules

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    x = text or ""
    w = WORD.findall(x)
    lines = [line for line in x.split("\n") if WORD.search(line)]
    windows = Counter(tuple(w[a : a + 8]) for a in range(len(w) - 7))
    covered = {q for a in range(len(w) - 7) if windows[tuple(w[a : a + 8])] > 1 for q in range(a, a + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(covered)


def plain_buckets(text):
    raw = (text or "").encode()
    for n in rules.GRAMS:
        for i in range(len(raw) - n + 1):
            h = 0
            for b in raw[i : i + n]:
                h = (h * 257 + b) % 2**32
            yield (h * 0x9E3779B1) % 2**32 >> 16


def check(rows, texts, trusted):
    raw, target = Counter(), Counter()
    grams = {k: list(plain_buckets(v)) for k, v in texts.items()}
    for k, g in grams.items():
        raw.update(g)
        if k in trusted:
            target.update(g)
    p_raw = lambda b: (raw[b] + 1) / (sum(raw.values()) + rules.BUCKETS)
    n_target = sum(target.values())
    logs = {b: np.log((target[b] + rules.BUCKETS * p_raw(b)) / (n_target + rules.BUCKETS) / p_raw(b)) for b in raw}
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        llr = float(np.mean([logs[b] for b in grams[r.doc_id]])) if grams[r.doc_id] else 0.0
        assert r.base_failed == failed and abs(r.llr - llr) < 1e-6 * max(1, abs(llr))
        assert r.kept == (not failed and llr >= rules.THRESHOLD)


def test_against_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    trusted = {r.doc_id for r in labels.filter("quality = 1 AND toxic = 0").collect()}
    check(rules.judge(docs, rules.ratio_table(docs, labels)).collect(), texts, trusted)


def test_base_counts_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rules.judge(docs, np.zeros(rules.BUCKETS)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(texts[r.doc_id])


def test_odd_rows(spark):
    odd = {1: None, 2: "", 3: "\n\n a\n\n a\n a\r\n a", 4: "w1 w2 w3 w4 w5 w6 w7 w8 " * 9, 5: "é|< > ü", 6: "ab", 7: "x y " * 60_000, 8: "\n", 9: "a\x0bb\x0cc\x1cd"}
    df = spark.createDataFrame([(k, v, "z", 1) for k, v in odd.items()], "doc_id long, text string, kept string, n_words int")
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = rules.judge(df, rules.ratio_table(df, labels)).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(odd[r.doc_id])
    assert len(rows) == len(odd)
    assert rules.judge(df.limit(0), rules.ratio_table(df.limit(0), labels)).count() == 0
    assert not rules.ratio_table(df, labels.limit(0)).any()
    twice = rules.judge(df.union(df), np.zeros(rules.BUCKETS)).collect()
    assert len(twice) == 2 * len(odd)


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = rules.judge(docs, rules.ratio_table(docs, labels)).drop("text").join(labels, "doc_id").filter("not base_failed").toPandas()
    clean = (got["quality"] == 1) & (got["toxic"] == 0)
    assert got["kept"][clean].mean() > 0.99 and got["kept"][got["quality"] == 0].mean() < 0.2


def test_every_trusted_document_is_counted(spark):
    docs = spark.range(21_000).selectExpr("id AS doc_id", "concat('word ', id, ' of ', id % 7) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    whole = rules.ratio_table(docs, None)
    assert whole.any() and np.array_equal(rules.ratio_table(docs, labels), whole)
