import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_jaccard import WORD, plain_components, plain_set
from tests.llm.test_packing import check as check_packing
from tests.llm.test_rules import plain_base
from tests.llm.test_secret_scan import plain as plain_secrets
from tracewell.llm import ordinal, rules, secret_scan
from tracewell.llm.shared import kept as kept_table

SF = "/root/testdata/sf0.01"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    grade = {r.doc_id: r.grade for r in labels.withColumn("grade", ordinal.grade_of()).collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "secret scans", "packing"]

    before = texts(docs)
    good = stages["quality classifier"](spark, docs, SF)
    assert good.columns == docs.columns
    after = texts(good)
    clean = [d for d in before if grade.get(d) == 2]
    assert all(before[d] == after[d] for d in after) and sum(d in after for d in clean) > 0.97 * len(clean)
    poor = [d for d in before if grade.get(d) == 0]
    assert sum(d in after for d in poor) < 0.3 * len(poor)

    ruled = stages["quality rules"](spark, good, SF)
    assert ruled.columns == docs.columns
    kept = texts(ruled)
    fails = {d for d, t in after.items() if (b := plain_base(t))[0] < 20 or 100 * b[4] > 30 * b[0]}
    judged = {r.doc_id: r.llr for r in rules.judge(good, rules.ratio_table(good, labels)).collect()}
    assert set(kept) == {d for d in after if d not in fails and judged[d] >= rules.THRESHOLD}

    single = stages["n-gram Jaccard join"](spark, ruled, SF)
    assert single.columns == docs.columns
    assert set(texts(single)) == {d for d, (_, c) in plain_components(kept).items() if d == c}

    safe = stages["secret scans"](spark, single, SF)
    assert safe.columns == docs.columns
    rows = safe.collect()
    assert {r.doc_id for r in rows} == set(texts(single))
    changed = 0
    for r in rows:
        assert r.text == plain_redaction(kept[r.doc_id]) and r.n_chars == len(r.text)
        changed += r.text != kept[r.doc_id]
    assert changed > 5

    check_packing(stages["packing"](spark, safe, SF).collect(), texts(safe))


#: the rules beyond the base kinds, in the operator's order of kinds
MORE = {r.kind: re.compile(r.pattern, re.A) for r in secret_scan.RULES if not r.base}


def plain_redaction(text):
    """Every span of a secret replaced by its kind; spans that overlap become one, named by the first."""
    spans = [(a, rank, kind, b) for a, rank, kind, b in plain_secrets(text)]
    spans += [(m.start(), 3 + k, kind, m.end()) for k, (kind, p) in enumerate(MORE.items()) for m in p.finditer(text)]
    out, at = "", 0
    for a, _, kind, b in sorted(spans):
        if a >= at:
            out += text[at:a] + f"[{kind}]"
        at = max(at, b)
    return out + text[at:]


def test_run_is_all_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())


#: names that operators use for columns of their own
CLASHES = ("rules", "found", "text_hash", "gone_id", "row", "key", "id", "n_words", "kept", "llr", "base_failed", "p_1", "p_2", "expected_grade", "label_id", "grade", "component_id", "n_shingles", "stays", "cell", "d", "slot", "mask", "at")


def odd_documents(spark):
    """Documents of the smallest scale, odd rows among them, and a column for each name that could clash."""
    few = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = few.orderBy(F.desc("n_chars")).first().text
    clean = next(r.text for r in few.filter("n_chars > 1200 AND n_chars < 4000").orderBy("doc_id").collect() if not plain_secrets(r.text))
    other = next(r.text for r in few.filter("n_chars > 1200 AND n_chars < 4000").orderBy(F.desc("doc_id")).collect() if not plain_secrets(r.text))
    odd = [(9001, None), (9002, ""), (None, None), (9003, " \n\t"), (9004, clean), (9004, clean), (None, clean), (None, clean), (9005, clean), (9006, other), (9006, clean), (None, other + " end"), (9007, (long + "\n") * 30), (9008, "token=abcdefgh1 " + other)]
    more = spark.createDataFrame(odd, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("odd")).withColumn("n_chars", F.length("text").cast(few.schema["n_chars"].dataType))
    docs = few.unionByName(more.withColumn("doc_id", F.col("doc_id").cast(few.schema["doc_id"].dataType)).select(*few.columns))
    for k, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k} of "), F.col("source")))
    return kept_table(docs)


def test_stages_with_odd_rows_and_clashing_names(spark):
    docs = odd_documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    own = lambda r: {c: r[c] for c in docs.columns if c not in ("text", "n_chars")}
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "")
    before = {key(r): r for r in docs.collect()}
    for name in ("quality classifier", "quality rules", "n-gram Jaccard join", "secret scans"):
        out = stages[name](spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.schema == docs.schema, name
        rows = out.collect()
        for r in rows:
            assert all(r[c] == f"{k} of {r.source}" for k, c in enumerate(CLASHES)), name
            if name != "secret scans":
                assert own(before[key(r)]) == own(r) and r.n_chars == before[key(r)].n_chars
        empty = stages[name](spark, docs.limit(0), "/root/testdata/sf0.001")
        assert empty.columns == docs.columns and empty.count() == 0, name
        have = Counter((r.doc_id, r.text) for r in rows)
        was = Counter((r.doc_id, r.text) for r in docs.collect())
        if name in ("quality classifier", "quality rules"):
            assert all(have[k] in (0, n) for k, n in was.items())  # rows that repeat share a verdict
        if name == "quality rules":
            assert not any(t is None or not t.strip() for _, t in have)
        if name == "secret scans":
            assert len(rows) == docs.count()
            assert have == Counter((d, None if t is None else plain_redaction(t)) for (d, t), n in was.items() for _ in range(n))
    assert stages["packing"](spark, docs.limit(0), "").count() == 0
    packed = stages["packing"](spark, docs.filter("source = 'odd'"), "").collect()
    assert {r.doc_id for r in packed} == {None, *range(9001, 9009)}


def test_one_document_of_each_group_stays(spark):
    """Repeated rows, one id with two texts and rows without an id, against the definition."""
    docs = odd_documents(spark)
    rows = docs.select("doc_id", "text").collect()
    out = Counter((r.doc_id, r.text) for r in corpus_pipeline.jaccard_join(spark, docs, "").collect())
    distinct = sorted({(r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows}, key=lambda x: x[:2])
    sets = {k: plain_set(t) for k, (_, _, t) in enumerate(distinct)}
    group = {k: c for k, (_, c) in plain_components({k: t for k, (_, _, t) in enumerate(distinct)}).items()}
    worded = {(None if none else doc, t) for none, doc, t in distinct if WORD.search(t)}
    for c in {group[k] for k in group if sets[k]}:
        inside = [distinct[k] for k in group if group[k] == c and sets[k]]
        least = min(x[:2] for x in inside)
        stays = [(None if none else doc, t) for none, doc, t in inside if out[None if none else doc, t]]
        assert len(stays) == 1 and out[stays[0]] == 1 and (stays[0][0] is None, stays[0][0] or 0) == least
    # what has no words all stays
    assert {k: n for k, n in out.items() if k not in worded} == {k: n for k, n in Counter((r.doc_id, r.text) for r in rows).items() if (k[0], k[1] or "") not in worded}
