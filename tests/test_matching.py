import itertools
import random

import numpy as np
import pandas as pd
import pytest

from tracewell.config import Tracker
from tracewell.functions.assignment import assign, hungarian, sparse_assignment
from tracewell.operators import matching, tracking
from tracewell.plans import presets
from tracewell.streaming import replay

BOX = "seq_id string, frame_index int, {} int, bb_left double, bb_top double, bb_width double, bb_height double"


def boxes(spark, key, rows):
    return spark.createDataFrame([("s", f, k, *map(float, b)) for f, k, b in rows], BOX.format(key))


def pairs(spark, dets, gt):
    return matching.box_pairs(boxes(spark, "det_idx", dets), boxes(spark, "gt_idx", gt), ["det_idx"], ["gt_idx"])


def metrics(spark, dets, gt, in_order=False):
    m = matching.greedy(pairs(spark, dets, gt), 0.5, in_order)
    return matching.detection_metrics(matching.per_frame(boxes(spark, "det_idx", dets), boxes(spark, "gt_idx", gt), m)).first()


def test_examples(spark):
    r = metrics(spark, [(1, 1, (10, 10, 20, 40)), (1, 2, (500, 500, 20, 40))], [(1, 1, (10, 10, 20, 40)), (1, 2, (200, 200, 20, 40))])
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (1, 1, 1, 0.5, 0.5, 0.5)
    r = metrics(spark, [(1, 1, (0, 0, 9, 9)), (2, 1, (0, 0, 9, 9)), (2, 2, (900, 0, 9, 9))], [(1, 1, (0, 0, 9, 9)), (2, 1, (0, 0, 9, 9))])
    assert (r.precision, r.recall, r.f1) == (pytest.approx(2 / 3), 1, pytest.approx(0.8))
    empty = spark.createDataFrame([("s", 1, 0, 0, 0)], "seq_id string, frame_index int, tp int, fp int, fn int")
    s = matching.frame_scores(empty).first()
    assert (s.precision, s.recall, s.f1) == (1, 1, 1)


def plain_iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    return both / (a[2] * a[3] + b[2] * b[3] - both)


def test_greedy_fuzz(spark):
    rng = random.Random(5)
    box = lambda: (rng.randrange(-50, 560, 6), rng.randrange(0, 300, 6), rng.choice((30, 36)), rng.choice((60, 300)))
    dets = [(f, k, box()) for f in range(1, 25) for k in range(1, 14)]
    gt = [(f, k, box()) for f in range(1, 25) for k in range(1, 14)]
    found = {(r.frame_index, r.det_idx, r.gt_idx): r.iou for r in pairs(spark, dets, gt).collect()}
    want = {(f, d, g): plain_iou(a, b) for f, d, a in dets for h, g, b in gt if f == h and plain_iou(a, b) > 0}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    for in_order in (False, True):
        got = {(r.frame_index, r.det_idx, r.gt_idx) for r in matching.greedy(pairs(spark, dets, gt), 0.3, in_order).collect()}
        key = (lambda k: (k[0], k[1], -found[k], k[2])) if in_order else (lambda k: (k[0], -found[k], k[1], k[2]))
        plain, used = set(), set()
        for f, d, g in sorted((k for k in found if found[k] >= 0.3), key=key):
            if not used & {(f, "d", d), (f, "g", g)}:
                used |= {(f, "d", d), (f, "g", g)}
                plain.add((f, d, g))
        assert got == plain


def test_assignment_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(150):
        n, m = rng.integers(1, 6, 2)
        w = np.where(rng.random((n, m)) < 0.6, rng.random((n, m)), 0)
        i, j = np.nonzero(w)
        take = assign(i, j, w[i, j])
        assert len(set(i[take])) == take.sum() == len(set(j[take]))
        wide = w if n <= m else w.T
        best = max(sum(wide[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert w[i, j][take].sum() == pytest.approx(best)
    cost = rng.random((4, 7))
    col = hungarian(cost)
    assert len(set(col)) == 4


def best_total(rows):
    """The largest total of a one-to-one choice among (left, right, score), by trying all."""
    if not rows:
        return 0
    (a, b, s), rest = rows[0], rows[1:]
    return max(best_total(rest), s + best_total([r for r in rest if r[0] != a and r[1] != b]))


def test_sparse_assignment_is_optimal():
    rng = np.random.default_rng(12)
    for _ in range(200):
        n = rng.integers(1, 11)
        pairs = {(int(a), int(b)) for a, b in rng.integers(0, 6, (n, 2))}
        rows = [(a, b, round(float(rng.random()) + 0.01, int(rng.integers(1, 5)))) for a, b in sorted(pairs)]
        take = sparse_assignment([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
        assert len({rows[k][0] for k in take}) == len(take) == len({rows[k][1] for k in take})
        assert sum(rows[k][2] for k in take) == pytest.approx(best_total(rows))
    # a component too large for a matrix: a chain, whose best choice is every second pair
    n = 400
    i, j, w = np.repeat(np.arange(n), 2), np.repeat(np.arange(n + 1), 2)[1:-1], np.tile([1.0, 0.9], n)
    assert w[assign(i, j, w)].sum() == pytest.approx(n)


def test_optimal_and_identity_against_brute_force(spark):
    rng = random.Random(6)
    box = lambda: (rng.randrange(0, 60, 6), rng.randrange(0, 60, 6), 30, rng.choice((40, 46)))
    tracks = [(f, k, box()) for f in range(1, 16) for k in range(1, 5)]
    gt = [(f, k, box()) for f in range(1, 16) for k in range(11, 15)]
    t, g = boxes(spark, "track_id", tracks), boxes(spark, "gt_id", gt)
    p = matching.box_pairs(t, g, ["track_id"], ["gt_id"])
    got = {}
    for r in matching.optimal(p, "track_id", "gt_id", 0.0).collect():
        got.setdefault(r.frame_index, []).append(r.iou)
    for f in range(1, 16):
        rows = [(a, b, float(np.float32(plain_iou(x, y)))) for fa, a, x in tracks for fb, b, y in gt if fa == fb == f and plain_iou(x, y) > 0]
        assert sum(got.get(f, [])) == pytest.approx(best_total(rows), abs=1e-5)
    shared = {}
    for fa, a, x in tracks:
        for fb, b, y in gt:
            if fa == fb and plain_iou(x, y) >= 0.3:
                shared[a, b] = shared.get((a, b), 0) + 1
    s = matching.identity_score(matching.overlap_counts(p, 0.3), t, g).first()
    best = best_total([(a, b, n) for (a, b), n in sorted(shared.items())])
    assert (s.idtp, s.idfp, s.idfn) == (best, 60 - best, 60 - best) and best > 5


def mot(spark, tracks, gt):
    t = boxes(spark, "track_id", tracks)
    g = boxes(spark, "gt_id", gt)
    p = matching.box_pairs(t, g, ["track_id"], ["gt_id"])
    m = matching.optimal(p, "track_id", "gt_id")
    return matching.clear_mot(t, g, m).first(), matching.identity_score(matching.overlap_counts(p), t, g).first()


def test_clear_mot(spark):
    b = (10, 10, 20, 40)
    r, i = mot(spark, [(1, 1, b), (2, 2, b)], [(1, 101, b), (2, 101, b)])
    assert (r.tp, r.id_switches, r.mota) == (2, 1, 0.5) and i.idf1 == 0.5
    r, i = mot(spark, [(1, k, (100 * k, 100, 20, 40)) for k in range(1, 6)], [(1, 101, b)])
    assert (r.fn, r.fp, r.mota) == (1, 5, -5.0)
    r, i = mot(spark, [(f, 1, b) for f in (1, 2, 3)], [(f, 7, b) for f in (1, 2, 3)])
    assert (r.mota, r.id_switches, i.idf1) == (1.0, 0, 1.0)


def frames_of(tracker, frames):
    """Emitted ids a frame, given {frame: [(box, confidence)]}."""
    rows = pd.DataFrame([(f, k, *map(float, b), c) for f, dets in frames.items() for k, (b, c) in enumerate(dets)], columns=["frame_index", "det_idx", "bb_left", "bb_top", "bb_width", "bb_height", "confidence"])
    out = {f: [] for f in frames}
    for r in tracking.run_frames(tracker, "s", rows, sorted(frames)):
        out[r[2]].append(r[1])
    return out


B = (100, 100, 50, 100)


def test_tracker_examples():
    assert frames_of(tracking.TwoStage(Tracker(min_hits=2)), {1: [(B, 0.9)], 2: [((102, 100, 50, 100), 0.9)]}) == {1: [], 2: [1]}
    assert frames_of(tracking.TwoStage(Tracker(min_hits=1)), {1: [(B, 0.9)], 2: [], 3: [(B, 0.25)]}) == {1: [1], 2: [], 3: [1]}
    t = tracking.TwoStage(Tracker(min_hits=1, max_lost_frames=2))
    states = []
    for f in range(1, 5):
        frames_of(t, {f: [(B, 0.9)] if f == 1 else []})
        states.append([x.state for x in t.tracks])
    assert states == [["confirmed"], ["lost"], ["lost"], []]
    assert frames_of(t, {9: [(B, 0.9)]}) == {9: [2]}
    gap = {10: [(B, 0.9)], 11: [(B, 0.9)], 12: [], 13: [], 14: [(B, 0.9)]}
    assert frames_of(tracking.TwoStage(Tracker(min_hits=1)), gap) == {10: [1], 11: [1], 12: [], 13: [], 14: [1]}
    assert frames_of(tracking.TwoStage(Tracker()), {1: [(B, 0.05)], 2: [(B, 0.3)]}) == {1: [], 2: []}


def test_tracker_streams_as_it_runs_in_batch(spark, tmp_path):
    from tracewell.plans import catalog
    from pyspark.sql import functions as F

    d = catalog.cameras(spark, "/root/testdata/sf0.001").select("seq_id", "frame_index", "det_idx", "bb_left", "bb_top", "bb_width", "bb_height", "confidence")
    frames = d.select("seq_id", "frame_index").distinct()
    batch = sorted(map(tuple, tracking.track(d, frames, Tracker(min_hits=1, match=0.1)).collect()))
    rows = d.unionByName(frames.withColumn("det_idx", F.lit(None).cast("int")), allowMissingColumns=True).toPandas()
    rows["det_idx"] = rows["det_idx"].astype("Int32")
    for k, (lo, hi) in enumerate(((1, 30), (31, 31), (32, 120))):
        rows[rows["frame_index"].between(lo, hi)].to_parquet(tmp_path / f"rows-{k}.parquet")
    stream = replay.read_files(spark, str(tmp_path), "rows-*.parquet", 1)
    got = replay.run_to_end(replay.track(stream.withColumn("frame_index", F.col("frame_index").cast("int")).withColumn("det_idx", F.col("det_idx").cast("int")), Tracker(min_hits=1, match=0.1)), "append")
    assert len(batch) > 20 and sorted(map(tuple, got.collect())) == batch


def test_dwell_streams_as_it_runs_in_batch(spark, tmp_path):
    from tracewell.operators import zones
    from tracewell.plans import catalog
    from tracewell.config import Dwell
    from pyspark.sql import functions as F

    p = catalog.FOOT(spark, "/root/testdata/sf0.001").select("seq_id", "track_id", "frame_index", "x", "y")
    want = sorted((r.track_id, r.zone_id, r.entry_frame, r.last_observed_frame, r.observation_count) for r in zones.visits(zones.memberships(p, presets.ZONES_09), Dwell(30, 2)).collect())
    pdf = p.withColumn("order", F.lit(0).cast("long")).toPandas()
    for k in range(4):
        pdf[(pdf["frame_index"] - 1) // 30 == k].to_parquet(tmp_path / f"p-{k}.parquet")
    stream = replay.read_files(spark, str(tmp_path), "p-*.parquet", 1)
    got = replay.latest_visits(replay.run_to_end(replay.dwell(stream, presets.ZONES_09, Dwell(30, 2)), "update"))
    assert sorted((r.track_id, r.zone_id, r.entry_frame, r.last_observed_frame, r.observation_count) for r in got.collect()) == want
