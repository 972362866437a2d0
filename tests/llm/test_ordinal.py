import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracewell.llm import ordinal, textscan

SF = "/root/testdata/sf0.1"


def tables(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def plain_features(text):
    """The features of one text by their definition, as ids."""
    raw = (text or "").encode()
    kept = bytes(b if chr(b).isascii() and chr(b).isalnum() or b > 127 else 32 for b in raw)
    words = kept.split(b" ")
    words = [w for w in words if w]
    fold = lambda w: w.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))

    def h(w):
        return int(textscan.Words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), np.array([0]), np.array([len(w)]), np.array([0, 1])).hashes()[0])

    out = {h(fold(w)) % ordinal.BUCKETS for w in words}
    out |= {int(textscan.mix(np.array([h(fold(w)[: ordinal.STEM]) + 1], np.uint64))[0]) % ordinal.BUCKETS for w in words if len(w) > ordinal.STEM}
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    again = sum(fold(a) == fold(b) for a, b in zip(words, words[1:]))
    shares = [upper / max(upper + lower, 1), sum(chr(b) in "#*$%&|<>!@^~=_{}[]\\" for b in raw) / max(len(raw), 1), again / max(len(words), 1), raw.count(b"|") / max(len(words), 1), math.log2(len(words) + 1) / 24]
    return out | {ordinal.BUCKETS + 24 * k + min(int(math.sqrt(min(max(s, 0), 1)) * 24), 23) for k, s in enumerate(shares)}


def test_features_and_scores_against_plain(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.01")
    model = ordinal.fit_on(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: None, -2: "", -3: "A|b {c} longer_Words Words"}
    column = pa.array([t or "" for t in texts.values()])
    raw, offsets = textscan.buffers(column)
    ids, first = ordinal.features(raw, offsets)
    rows = {r.doc_id: r for r in ordinal.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    for k, (doc, text) in enumerate(texts.items()):
        plain = plain_features(text)
        assert set(ids[first[k] : first[k + 1]].tolist()) == plain and first[k + 1] - first[k] == len(plain)
        s = sum(float(model.weights[f]) for f in plain)
        tails = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        assert np.allclose([rows[doc].p_1, rows[doc].p_2, rows[doc].expected_grade], [*tails, sum(tails)], atol=1e-5)


def plain_loss(w, t, lists, grades):
    """Mean negative log-likelihood of the cumulative-link model."""
    total = 0.0
    for f, y in zip(lists, grades):
        s = sum(w[k] for k in f)
        up = 1 / (1 + math.exp(s - t[y])) if y < len(t) else 1.0
        low = 1 / (1 + math.exp(s - t[y - 1])) if y else 0.0
        total -= math.log(up - low)
    return total / len(lists)


def test_one_step_follows_the_gradient():
    """A first step of one minibatch goes against the numerical gradient of the loss, by the rate in each weight."""
    rng = np.random.default_rng(4)
    lists = [sorted(rng.choice(6, rng.integers(1, 5), replace=False).tolist()) for _ in range(200)]
    grades = rng.integers(0, 3, 200)
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    ids = np.concatenate(lists)
    start = ordinal.fit(ids, first, grades, 3, steps=1, rate=0.0, l1=0, l2=0, least=1, threshold_rate=0.0)
    moved = ordinal.fit(ids, first, grades, 3, steps=1, rate=1e-3, l1=0, l2=0, least=1, threshold_rate=1e-3)
    t = start.thresholds
    for k in range(6):
        e = np.zeros(6)
        e[k] = 1e-5
        slope = (plain_loss(e, t, lists, grades) - plain_loss(-e, t, lists, grades)) / 2e-5
        # AdaGrad's first step has the size of the rate, but for the small sum that it starts with
        assert abs(moved.weights[k] + 1e-3 * slope / math.sqrt(slope * slope + 1e-6)) < 2e-6
    for k in range(2):
        e = np.zeros(2)
        e[k] = 1e-5
        slope = (plain_loss(np.zeros(6), t + e, lists, grades) - plain_loss(np.zeros(6), t - e, lists, grades)) / 2e-5
        assert abs(moved.thresholds[k] - t[k] + 1e-3 * slope / math.sqrt(slope * slope + 1e-6)) < 2e-6


def test_the_sample_is_the_same_in_every_run(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.01")
    more = docs.union(docs).union(docs.withColumn("text", F.concat("text", F.lit(" again"))))
    one = ordinal.fit_on(more.repartition(7, "text"), labels, most=150)
    two = ordinal.fit_on(more.repartition(3, "doc_id"), labels, most=150)
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.thresholds, two.thresholds)


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4))
    model = ordinal.fit_on(docs, labels.filter(fold > 0))
    assert (np.diff(model.thresholds) > 0).all()
    held = labels.filter(fold == 0).withColumn("grade", ordinal.grade_of())
    got = ordinal.score(docs.join(held, "doc_id").select("doc_id", "text", "grade"), model).toPandas()
    assert np.allclose(got["expected_grade"], got["p_1"] + got["p_2"]) and (got["p_1"] >= got["p_2"]).all()
    kept = got["p_2"] >= ordinal.KEEP
    assert kept[got["grade"] == 2].mean() > 0.985
    assert kept[got["grade"] == 0].mean() < 0.15
    means = got.groupby("grade")["expected_grade"].mean()
    assert means[0] < means[1] < means[2]


def test_gradient():
    """The fitted model's likelihood is at a maximum in its thresholds on separable-free data."""
    rng = np.random.default_rng(1)
    n = 4000
    x = rng.random((n, 6)) < 0.4
    s = x @ np.array([2.0, -2.0, 1.0, 0.0, 0.5, -1.0])
    grades = (s + rng.logistic(size=n) > -0.5).astype(int) + (s + rng.logistic(size=n) > 1.5) * 1
    first = np.concatenate([[0], np.cumsum(x.sum(1))])
    ids = np.nonzero(x)[1]
    m = ordinal.fit(ids, first, np.clip(grades, 0, 2), 3, l1=0, l2=0)
    w = m.weights[:6]
    assert w[0] > 1 and w[1] < -1 and abs(w[3]) < 0.5 and w[2] > w[4] > w[5]


def test_odd_rows(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.01")
    labels = labels.union(labels.limit(30)).union(spark.createDataFrame([(None, 1, 0), (5, None, 0), (6, 1, None)], labels.schema))
    model = ordinal.fit_on(docs, labels)
    df = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "the text", 3.0), (3, "long " * 80_000, 4.0), (4, "same", 5.0), (4, "same", 5.0)], "doc_id long, text string, p_1 double")
    rows = ordinal.score(df, model).collect()
    assert len(rows) == 6 and rows[0].p_1 == rows[1].p_1 and rows[4] == rows[5] and all(0 <= r.p_2 <= r.p_1 <= 1 for r in rows)
    assert ordinal.score(df.limit(0), model).count() == 0
    empty = ordinal.fit_on(docs.limit(0), labels)
    assert ordinal.score(df, empty).count() == 6
    # the bound holds
    assert ordinal.labelled_sample(labels, 50).count() == 50
