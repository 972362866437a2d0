"""Boxes of one frame matched without a table of pairs: against brute force, and with crowds of copies."""

import re

import duckdb
import numpy as np
import pytest

from tracewell.functions import overlaps
from tracewell.functions.assignment import assign
from tracewell.operators import matching
from tracewell.plans import catalog
from tests.test_matching import boxes


def all_pairs(a, b):
    """{(i, j): IoU} of the boxes that overlap, one by one."""
    out = {}
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            if np.isfinite([*p, *q]).all() and (p[2:] > p[:2]).all() and (q[2:] > q[:2]).all():
                w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
                if w > 0 and h > 0:
                    out[i, j] = w * h / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - w * h)
    return out


def some_boxes(rng, n, odd):
    corner = rng.integers(-1, 2, 1) * 40 + rng.integers(0, rng.choice([15, 60, 300]), (n, 2))
    side = np.exp(rng.normal(2.5, 1, (n, 2))) if rng.random() < 0.5 else rng.choice([10.0, 12, 20], (n, 2))
    out = np.column_stack([corner, corner + side]).astype(float)
    if odd and n > 4:  # not a number, far too large, flat, endless
        out[:4] = [np.nan, 0, 1, 1], [-1e6, -1e6, 1e6, 1e6], [5, 5, 5, 9], [0, 0, np.inf, 4]
    return out


@pytest.mark.parametrize("few, block", [(overlaps.FEW, overlaps.BLOCK), (0, overlaps.BLOCK), (0, 7)])
def test_pairs_and_choices_against_brute_force(monkeypatch, few, block):
    monkeypatch.setattr(overlaps, "FEW", few)
    monkeypatch.setattr(overlaps, "BLOCK", block)
    rng = np.random.default_rng(21)
    for k in range(40):
        a, b = some_boxes(rng, rng.integers(0, 35), k % 3 == 0), some_boxes(rng, rng.integers(0, 35), k % 4 == 0)
        every, ids, gids = all_pairs(a, b), rng.permutation(len(a)), rng.permutation(len(b))
        for least in (0.0, 0.1, 0.5, 0.9):
            i, j, iou = overlaps._by_left(a, b, least)
            assert dict(zip(zip(i.tolist(), j.tolist(), strict=True), iou.tolist(), strict=True)) == {p: s for p, s in every.items() if s >= least}
        i, j, iou = overlaps.best_pairs(a, b, ids, gids)
        assert len(set(i)) == len(i) == len(set(j)) and all(every[p] == s for p, s in zip(zip(i.tolist(), j.tolist(), strict=True), iou.tolist(), strict=True))
        score = np.array(list(every.values()), np.float32)
        best = assign(np.array([p[0] for p in every], int), np.array([p[1] for p in every], int), score)
        assert iou.astype(np.float32).sum(dtype=float) == pytest.approx(score[best].sum(dtype=float), abs=1e-6)
        for in_order in (False, True):
            key = (lambda p: (ids[p[0]], -every[p], gids[p[1]])) if in_order else (lambda p: (-every[p], ids[p[0]], gids[p[1]]))  # noqa: B023
            plain, used = set(), set()
            for p in sorted((p for p in every if every[p] >= 0.3), key=key):
                if not used & {("a", p[0]), ("b", p[1])}:
                    used |= {("a", p[0]), ("b", p[1])}
                    plain.add(p)
            assert set(zip(*(x.tolist() for x in overlaps.greedy_pairs(a, b, ids, gids, 0.3, in_order)), strict=True)) == plain


def test_repeated_ids_count_once():
    a, ids = np.array([[0, 0, 9, 9], [20, 0, 29, 9.0]]), np.array([5, 5])
    i, j, _ = overlaps.best_pairs(a, a, ids, np.array([1, 2]))
    assert len(i) == 1
    i, j = overlaps.greedy_pairs(a, a, ids, np.array([1, 2]), 0.5)
    assert (i.tolist(), j.tolist()) == ([0], [0])


@pytest.fixture(scope="module")
def crowd(tmp_path_factory):
    """The smallest events four times over, as other people who stand in the very same boxes."""
    d = tmp_path_factory.mktemp("crowd")
    con = duckdb.connect()
    con.sql(f"COPY (SELECT event_id + 70000 * r AS event_id, ts, user_id + 46000 * r AS user_id, event_type, value, props FROM '/root/testdata/sf0.001/events.parquet', range(4) t(r)) TO '{d}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    return str(d), con


def in_crowd(spark, crowd, name):
    """The query's rows and its SQL's rows."""
    df, rel = catalog.QUERIES[name](spark, crowd[0]), crowd[1].execute(catalog.ORACLES[name])
    cols = [c[0] for c in rel.description]
    return sorted(map(tuple, df.select(cols).collect())), sorted(rel.fetchall()), df


def lists_no_pairs(df):
    """Only boxes reach a frame's task: no join makes pairs below it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "FlatMapCoGroupsInArrow" in plan and "Join" not in plan.partition("FlatMapCoGroupsInArrow")[2]


def test_clear_mot_in_a_crowd(spark, crowd):
    mine, theirs, df = in_crowd(spark, crowd, "clear_mot")
    assert mine == theirs and mine[0][3] == mine[0][4] == 0  # no miss, no switch between copies
    assert lists_no_pairs(df)


def test_optimal_boxes_is_optimal_of_their_pairs(spark):
    rng = np.random.default_rng(4)
    rows = lambda n: [(int(f), k, tuple(map(int, (*rng.integers(0, 60, 2), 30, 40)))) for f in range(1, 9) for k in range(1, n)]
    t, g = boxes(spark, "track_id", rows(9)), boxes(spark, "gt_id", rows(7))
    p = matching.box_pairs(t, g, ["track_id"], ["gt_id"])
    total = lambda df: sorted((r.frame_index, round(r.s, 5)) for r in df.groupBy("frame_index").agg({"iou": "sum"}).withColumnRenamed("sum(iou)", "s").collect())
    mine = matching.optimal_boxes(t, g, "track_id", "gt_id", 0.0)
    assert total(mine) == total(matching.optimal(p, "track_id", "gt_id", 0.0)) and mine.join(p, [*p.columns]).count() == mine.count() > 20
    assert mine.schema == matching.optimal(p, "track_id", "gt_id").schema


def test_lap_match_in_a_crowd(spark, crowd):
    mine, theirs, df = in_crowd(spark, crowd, "lap_match")
    assert mine == theirs and len(mine) > 1000
    assert lists_no_pairs(df)


def test_greedy_in_a_crowd(spark, crowd):
    mine, theirs, df = in_crowd(spark, crowd, "det_match_global_greedy")
    assert mine == theirs and len(mine) > 900
    assert lists_no_pairs(df)


@pytest.mark.parametrize("in_order", [False, True])
def test_greedy_boxes_is_greedy_of_their_pairs(spark, in_order):
    rng = np.random.default_rng(8)
    rows = [(int(f), k, tuple(map(int, (*rng.integers(0, 50, 2), 30, 40)))) for f in range(1, 9) for k in range(1, 12)]
    d, g = boxes(spark, "det_idx", rows[::2]), boxes(spark, "gt_idx", rows[1::2])
    want = matching.greedy(matching.box_pairs(d, g, ["det_idx"], ["gt_idx"]), 0.2, in_order)
    mine = matching.greedy_boxes(d, g, 0.2, in_order)
    assert mine.schema == want.schema and sorted(map(tuple, mine.collect())) == sorted(map(tuple, want.collect())) != []


@pytest.mark.parametrize("name", ["det_metrics_global", "det_metrics_in_order", "frame_union"])
def test_metrics_in_a_crowd(spark, crowd, name):
    mine, theirs, df = in_crowd(spark, crowd, name)
    assert [pytest.approx(r) for r in theirs] == mine
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert lists_no_pairs(df) and "aggregate(" not in plan  # boxes alone reach a frame's task, and no fold follows


def test_unmatched_in_a_crowd(spark, crowd):
    mine, theirs, df = in_crowd(spark, crowd, "unmatched_detections")
    assert mine == theirs and len(mine) > 500
    assert lists_no_pairs(df)


def test_report_in_a_crowd(spark, crowd):
    mine, theirs, df = in_crowd(spark, crowd, "report_json")
    assert [r[:2] for r in mine] == [r[:2] for r in theirs] and [r[2] for r in mine] == pytest.approx([r[2] for r in theirs])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "array_append" not in plan


@pytest.mark.parametrize("in_order", [False, True])
def test_greedy_never_lists_pairs_of_boxes_that_are_gone(monkeypatch, in_order):
    rng = np.random.default_rng(5)
    corner = rng.random((1200, 2)) * 60
    boxes_ = np.column_stack([corner, corner + (40, 80)])
    a, b = boxes_[:600], boxes_[600:]
    every, listed, test = len(overlaps._by_left(a, b, 0.5)[0]), [], overlaps._by_left
    monkeypatch.setattr(overlaps, "_by_left", lambda *args: listed.append(out := test(*args)) or out)
    i, j = overlaps.greedy_pairs(a, b, np.arange(600), np.arange(600), 0.5, in_order)
    assert sum(len(x[0]) for x in listed) < 0.6 * every
    monkeypatch.setattr(overlaps, "FEW", 1 << 20)  # all pairs at once
    k, m = overlaps.greedy_pairs(a, b, np.arange(600), np.arange(600), 0.5, in_order)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(k.tolist(), m.tolist(), strict=True)) and len(i) > 500


@pytest.mark.parametrize("in_order", [False, True])
def test_greedy_frames_counts_every_frame(spark, in_order):
    rng = np.random.default_rng(9)
    rows = [(int(f), k, tuple(map(int, (*rng.integers(0, 50, 2), 30, 40)))) for f in range(1, 7) for k in range(1, 9)]
    d, g = boxes(spark, "det_idx", [*rows[::2], (20, 1, (0, 0, 5, 5))]), boxes(spark, "gt_idx", [*rows[1::2], (30, 1, (0, 0, 5, 5))])  # frames of one side alone
    want = matching.per_frame(d, g, matching.greedy_boxes(d, g, 0.2, in_order))
    mine = matching.greedy_frames(d, g, 0.2, in_order)
    assert mine.dtypes == want.dtypes and sorted(map(tuple, mine.collect())) == sorted(map(tuple, want.collect())) and mine.count() == 8


def test_frame_union_reads_each_side_once(spark, crowd):
    plan = catalog.frame_union(spark, crowd[0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_report_has_methods_that_the_jvm_compiles(spark, crowd):
    """HotSpot leaves methods of over 8,000 bytes to its interpreter."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalog.report_json(spark, crowd[0])._jdf.queryExecution().executedPlan()
        code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert len(sizes) > 10 and max(sizes) < 8000
