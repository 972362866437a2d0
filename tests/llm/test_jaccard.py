import random
import re
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import jaccard
from tracewell.llm.components import components
from tracewell.llm.shared import KeyFilter

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, words=4):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)])


def plain_components(texts, percent=85):
    sets = {k: plain_set(v) for k, v in texts.items()}
    up = {k: k for k in texts}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    by = {}
    for k, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(k)
    pairs = {(a, b) for v in by.values() for i, a in enumerate(v) for b in v[:i]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in texts}


def got(df, **more):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(df, **more).collect()}


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got(docs) == plain_components(texts)


def test_whole_cells_under_skew_splits(spark):
    """Spark must not split a cell's partition when it splits skewed joins."""
    texts = near_copies(150, 60, 8) | {k + 1000: v for k, v in near_copies(30, 80, 8, 2).items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(12)
    forced = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64b", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64b", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in forced}
    try:
        for k, v in forced.items():
            spark.conf.set(k, v)
        assert got(docs) == plain_components(texts)
        assert got(docs, cell=24, pivots=4) == plain_components(texts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def near_copies(n, words, edits, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = {}
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out[k] = " ".join(w)
    return out


def test_large_cells_recurse(spark):
    texts = near_copies(220, 120, 14) | {k + 1000: v for k, v in near_copies(60, 300, 30, 2).items()}
    texts |= {2000 + k: "the common passage of many texts that says the same again " * 2 + " ".join(f"u{k}x{i}" for i in range(12)) for k in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = plain_components(texts)
    assert len({c for _, c in want.values()}) > 20
    assert got(df, cell=24, pivots=4) == want
    assert got(df) == want


def test_regions_recurse(spark, monkeypatch):
    """A group of far clusters, each still too large to join at once, and each of clusters that link little."""
    rng, texts = random.Random(17), {}
    for c in range(7):
        base = [f"c{c}w{rng.randrange(400)}" for _ in range(90)]
        for s in range(6):
            inner = list(base)
            for _ in range(7):
                inner[rng.randrange(90)] = f"c{c}s{s}x{rng.randrange(10**6)}"
            for k in range(9):
                w = list(inner)
                for _ in range(rng.randrange(4)):
                    w[rng.randrange(90)] = f"e{rng.randrange(10**6)}"
                texts[c * 1000 + s * 100 + k] = " ".join(w)
    how = jaccard.Shingling()
    levels, real = [], jaccard.to_pivots
    monkeypatch.setattr(jaccard, "to_pivots", lambda *a: levels.append(1) or real(*a))
    rows = []
    import zstandard

    for k, t in texts.items():
        (h, first) = jaccard.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 4)
        rows.append((1, int(jaccard.digests(h, first)[0]), len(h), zstandard.compress(t.encode()), k))
    members = spark.createDataFrame(rows, "cell long, d long, n int, text binary, k int")
    links = jaccard.join_large(members.drop("k"), how, 12, 8)
    assert len(levels) > 1
    label = {r.node: r.label for r in components(links).collect()}
    mine, want = {}, {}
    for _, d, _, _, k in rows:
        mine.setdefault(label.get(d, d), set()).add(k)
    for k, (_, c) in plain_components(texts).items():
        want.setdefault(c, set()).add(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values())) and 7 < len(want) < len(texts)


def test_odd_rows(spark):
    odd = {1: None, 2: "", 3: " \n", 4: "One", 5: "one", 6: "a b c", 7: "A B C", 8: "a b c d", 9: "x y z w v " * 3000, 10: "x y z w v " * 2999, 11: "ÉCOLE a b c", 12: "école a b c"}
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in odd.items()], "doc_id long, text string, cell int, d1 int")
    assert got(df) == plain_components(odd)
    twice = jaccard.similar_components(df.union(df)).collect()
    assert len(twice) == 2 * len(odd)
    assert jaccard.similar_components(df.limit(0)).count() == 0
    nul = jaccard.similar_components(df.union(spark.createDataFrame([(None, "a b c", 1, 2)], df.schema))).collect()
    assert [r.component_id for r in nul if r.doc_id is None] == [None] and len(nul) == len(odd) + 1


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 60), st.booleans())
def test_join_sets_is_exact(seed, n, parted):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) > rng.random() * 0.3], rng.integers(0, 2**63, rng.integers(0, 8)).astype(np.uint64)])) for _ in range(n)]
    sides = rng.integers(0, 2, n) if parted else None
    how = jaccard.Shingling()
    links = {(i, j) for i in range(n) for j in range(i) if (sides is None or sides[i] or sides[j]) and how.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    mine = jaccard.join_sets(sets, how, sides)
    assert {(max(p), min(p)) for p in mine} <= links

    def parts(edges):
        f = jaccard.Forest(n)
        for i, j in edges:
            f.join(i, j)
        return f.roots().tolist()

    assert parts(mine) == parts(links)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(2, 12))
def test_bits_drop_no_link(seed, size, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, size).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(size) > rng.random() * 0.2], rng.integers(0, 2**63, rng.integers(1, 2 + size // 8)).astype(np.uint64)])) for _ in range(n)]
    how = jaccard.Shingling()
    forest = jaccard.Forest(n)
    for i, j in jaccard.bit_forest(np.array([len(s) for s in sets]), [jaccard.parity_bits(s) for s in sets], how):
        forest.join(i, j)
    for i in range(n):
        for j in range(i):
            if how.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                assert forest.root(i) == forest.root(j)


def test_filter_passes_what_is_chosen(spark):
    rng = np.random.default_rng(9)
    d = rng.integers(-(2**63), 2**63 - 1, 5000)
    d[:3] = -1, 0, 63
    chosen = spark.createDataFrame([(int(x),) for x in d[:3000]], "d1 long")
    wanted = KeyFilter.of(chosen, "d1")
    assert wanted.passes(d[:3000]).all() and wanted.passes(d[3000:]).mean() < 0.01
    assert not KeyFilter.of(chosen.limit(0), "d1").words.any()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)]
    f = jaccard.Forest(2000)
    for a, b in edges:
        f.join(a, b)
    have = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for k in {x for e in edges for x in e}:
        assert have.get(k, k) == f.root(k)


def test_few_files_whatever_the_partitions(spark, monkeypatch):
    """Small tables go in few files: each file of a local folder is two processes forked from the JVM."""
    texts = near_copies(60, 300, 6) | {1000 * c + k: v for c in range(1, 30) for k, v in near_copies(4, 60, 3, c).items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    files, real = [], jaccard.kept

    def counted(*a):
        out = real(*a)
        files.append(len(list(Path(out.kept_at.removeprefix("file://").removeprefix("file:")).glob("part-*"))))
        return out

    monkeypatch.setattr(jaccard, "kept", counted)
    monkeypatch.setattr("tracewell.llm.components.kept", counted)
    forced = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in forced}
    try:
        for k, v in forced.items():
            spark.conf.set(k, v)
        assert got(docs, cell=24, pivots=4) == plain_components(texts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 15 and max(files) <= 8, files
