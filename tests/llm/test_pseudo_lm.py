import random
import re

import numpy as np

from tracewell.llm import pseudo_lm

SF = "/root/testdata/sf0.01"


def plain_score(text, ids_of, model):
    """Token by token, by the definition."""
    raw = text.encode()
    buckets, _ = pseudo_lm.word_buckets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    ids = ids_of[buckets].tolist()
    assert len(ids) == len(re.findall(r"[^\x20\x09-\x0D]+", text))
    total = 0.0
    for i, y in enumerate(ids):
        near = [ids[j] if 0 <= j < len(ids) else pseudo_lm.EDGE for j in (i - 2, i - 1, i + 1, i + 2)]
        h = np.append(np.tanh(sum(model.inner[w] * model.place[k] for k, w in enumerate(near))), 1)
        a, b = model.classes @ h, model.outer[y // pseudo_lm.MEMBERS] @ h
        total += a[y // pseudo_lm.MEMBERS] - np.log(np.exp(a).sum()) + b[y % pseudo_lm.MEMBERS] - np.log(np.exp(b).sum())
    return total


def test_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    ids_of, model = pseudo_lm.fit(docs)
    rows = pseudo_lm.score(docs, ids_of, model).collect()
    assert len(rows) == 1000
    for r in rows:
        assert np.isclose(r.pseudo_log_likelihood, plain_score(r.text, ids_of, model), rtol=1e-4, atol=1e-3)
    # held-out texts: better than the start, whose biases are the unigram distribution
    start = pseudo_lm.Model.new(pseudo_lm.vocabulary(docs)[1])
    held = docs.filter("pmod(xxhash64(text), 4) >= 2")
    ids_of, model = pseudo_lm.fit(docs, share=4)
    before, after = (pseudo_lm.score(held, ids_of, m).selectExpr("sum(pseudo_log_likelihood) / sum(n_tokens) AS x").first().x for m in (start, model))
    assert after > before + 0.02


def test_words_in_order_score_higher(spark):
    rng = random.Random(4)
    names = [f"n{i}" for i in range(60)]
    line = lambda: " ".join(f"the {rng.choice(names)} of {rng.choice(names)} is here and" for _ in range(30))
    docs = spark.createDataFrame([(i, line()) for i in range(600)], "doc_id long, text string")
    ids_of, model = pseudo_lm.fit(docs, share=2)
    text = line()
    mixed = text.split()
    rng.shuffle(mixed)
    a, b = pseudo_lm.score(spark.createDataFrame([(1, text), (2, " ".join(mixed))], "doc_id long, text string"), ids_of, model).collect()
    assert a.n_tokens == b.n_tokens and a.mean_log_probability > b.mean_log_probability + 0.5


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, " \n", 1), (None, "one", 1), (3, "very long text " * 20_000, 2), (4, "one", 2), (4, "one", 2)], "doc_id long, text string, n_tokens int")
    rows = pseudo_lm.score(df, *pseudo_lm.fit(df, share=1)).collect()
    assert [r.n_tokens for r in rows] == [0, 0, 1, 60_000, 1, 1]
    assert rows[0].mean_log_probability is None and rows[0].pseudo_log_likelihood == 0
    assert rows[4] == rows[5] and np.isfinite(rows[3].pseudo_log_likelihood)
    none = df.limit(0)
    assert pseudo_lm.score(none, *pseudo_lm.fit(none)).count() == 0


def test_every_text_is_trained_on(spark):
    made = spark.range(400).selectExpr("id AS doc_id", "concat('the word ', id, ' is here and there') AS text")
    for k in (6, 9):  # of one parity each, so of one round each
        docs = made.filter(f"pmod(xxhash64(text), 16) = {k}").coalesce(1)
        assert docs.count()
        start = pseudo_lm.Model.new(pseudo_lm.vocabulary(docs)[1])
        assert not np.array_equal(pseudo_lm.fit(docs)[1].flat(), start.flat())


def test_a_step_adds_up_its_gradients_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, pseudo_lm.VOCAB, 2 * pseudo_lm.STEP)
    around = pseudo_lm.windows(ids, np.array([0, 100, len(ids)]))
    model, calls, count = pseudo_lm.Model.new(np.bincount(ids, minlength=pseudo_lm.VOCAB)), [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *args, **more: calls.append(1) or count(*args, **more))
    before = model.log_probs(ids, around).sum()
    model.train(ids, around)
    assert len(calls) == 2  # one a step, not one a place and column
    assert model.log_probs(ids, around).sum() > before


def test_large_logits_are_shifted():
    rng = np.random.default_rng(6)
    ids = rng.integers(0, pseudo_lm.VOCAB, 500)
    around = pseudo_lm.windows(ids, np.array([0, len(ids)]))
    model = pseudo_lm.Model.new(np.ones(pseudo_lm.VOCAB))
    assert model.is_plain()
    flat = model.flat()
    big, small = pseudo_lm.Model.of(flat), pseudo_lm.Model.of(flat)
    big.classes[:, -1] += 200  # the same distribution
    big.outer[:, :, -1] -= 200
    assert not big.is_plain()
    assert np.allclose(big.log_probs(ids, around), model.log_probs(ids, around), atol=1e-3)
    big.train(ids, around)
    small.train(ids, around)
    assert np.isfinite(big.flat()).all() and np.allclose(big.inner, small.inner, atol=0.05)
