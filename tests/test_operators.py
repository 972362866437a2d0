import math
import random

import pytest
from pyspark.sql import functions as F

from tracewell.config import Dwell, GroundGrid, ImageGrid, Zone, Zones
from tracewell.operators import audit, ground, heatmaps, tracks, zones
from tracewell.plans import presets

MEMBER = "seq_id string, track_id int, frame_index int, zone_ids array<string>"
POINT = "seq_id string, track_id int, frame_index int, x double, y double, confidence double"


def visits_of(spark, rows, gap=0, fps=10.0):
    df = spark.createDataFrame([("s", t, f, list(z)) for t, f, z in rows], MEMBER)
    return zones.visits(df, Dwell(fps, gap))


def told(df):
    return sorted((r.zone_id, r.entry_frame, r.last_observed_frame, r.observation_count, round(r.duration_seconds, 6)) for r in df.collect())


def test_dwell_examples(spark):
    assert told(visits_of(spark, [(1, 10, "A"), (1, 11, "A")])) == [("A", 10, 11, 2, 0.1)]
    assert told(visits_of(spark, [(1, 10, "A"), (1, 12, "A")])) == [("A", 10, 10, 1, 0), ("A", 12, 12, 1, 0)]
    assert told(visits_of(spark, [(1, 10, "A"), (1, 13, "A")], 2)) == [("A", 10, 13, 2, 0.3)]
    assert len(told(visits_of(spark, [(1, 10, "A"), (1, 14, "A")], 2))) == 2
    assert told(visits_of(spark, [(1, 10, "AB"), (1, 11, "AB"), (1, 12, "B"), (1, 13, "")])) == [("A", 10, 11, 2, 0.1), ("B", 10, 12, 3, 0.2)]
    assert len(told(visits_of(spark, [(1, 10, "A"), (1, 11, ""), (1, 12, "A")], 5))) == 2
    a = zones.zone_analytics(visits_of(spark, [(1, 10, "A"), (1, 15, "A"), (1, 30, "A"), (2, 20, "A"), (2, 22, "A")], 10), Zones.of(Zone.box("A", 0, 0, 1, 1), Zone.box("Z", 0, 0, 1, 1)), Dwell(10))
    r = {x.zone_id: x for x in a.collect()}
    assert (r["A"].total_visits, r["A"].unique_visitors, r["A"].total_observations) == (3, 2, 5)
    assert r["A"].total_dwell_time == pytest.approx(0.7) and r["A"].average_dwell_time == pytest.approx(0.7 / 3) and r["A"].max_dwell_time == 0.5
    assert r["Z"].total_visits == 0 and r["Z"].average_dwell_time == 0


def plain_visits(rows, gap):
    """A state machine over each track's observations."""
    out = []
    for t in {r[0] for r in rows}:
        opened, last = {}, None
        for _, f, z in sorted(r for r in rows if r[0] == t):
            for zone in list(opened):
                if zone not in z or f - last - 1 > gap:
                    out.append((t, zone, *opened.pop(zone)))
            for zone in z:
                a, _, n = opened.get(zone, (f, f, 0))
                opened[zone] = (a, f, n + 1)
            last = f
        out += [(t, zone, *v) for zone, v in opened.items()]
    return sorted(out)


def test_dwell_fuzz(spark):
    rng = random.Random(8)
    rows = [(t, f, "".join(c for c in "ABC" if rng.random() < 0.5)) for t in range(30) for f in rng.sample(range(1, 60), 35)]
    for gap in (0, 1, 2, 4):
        got = sorted((r.track_id, r.zone_id, r.entry_frame, r.last_observed_frame, r.observation_count) for r in visits_of(spark, rows, gap).collect())
        assert got == plain_visits(rows, gap)


def test_active_visits(spark):
    v = visits_of(spark, [(1, 1, "A"), (1, 2, "A"), (1, 3, "A"), (2, 3, "A"), (2, 5, "A")])
    frames = spark.createDataFrame([("s", f) for f in range(1, 7)], "seq_id string, frame_index int")
    assert [r.active_visits for r in zones.active_visits(v, frames).orderBy("frame_index").collect()] == [1, 1, 2, 0, 1, 0]


def points(spark, rows):
    return spark.createDataFrame([("s", t, f, float(x), float(y), 1.0) for t, f, x, y in rows], POINT)


def test_footpoints(spark):
    box = "seq_id string, track_id int, frame_index int, bb_left double, bb_top double, bb_width double, bb_height double, confidence double"
    df = spark.createDataFrame([("s", 1, 1, -10.0, -20.0, 4.0, 8.0, 0.5), ("s", 2, 1, 0.0, 0.0, 0.0, 5.0, 1.0), ("s", 3, 1, math.nan, 0.0, -1.0, 5.0, 1.0), ("s", 4, 1, 0.0, 0.0, 5.0, -1.0, 1.0)], box)
    ok = tracks.footpoints(df).collect()
    assert [(r.x, r.y, r.confidence) for r in ok] == [(-8.0, -12.0, 0.5)]
    assert {r.track_id: r.status for r in tracks.bad_boxes(df).collect()} == {2: "WIDTH", 3: "NON_FINITE", 4: "HEIGHT"}
    with pytest.raises(Exception, match="no foot point"):
        tracks.footpoints(df, "strict").collect()


def test_trajectory_summary(spark):
    p = points(spark, [(1, f, 0, 0) for f in (1, 2, 5)] + [(2, f, 0, 0) for f in (3, 4, 5)])
    r = tracks.summary(p, 10).first()
    assert (r.total_trajectories, r.total_observations, r.total_gaps, r.min_gap_frames, r.max_gap_frames, r.trajectories_with_gaps) == (2, 6, 1, 2, 2, 1)
    assert (r.min_lifespan_frames, r.max_lifespan_frames, r.median_lifespan_frames, r.frame_coverage_ratio, r.max_lifespan_seconds) == (3, 5, 4.0, 0.75, 0.5)
    none = tracks.summary(p.limit(0), 10).first()
    assert all(v == 0 for v in none.asDict().values())
    assert tracks.duplicates(p.union(p.limit(1))).count() == 1
    assert [(r.previous_frame, r.frame_index, r.gap_frames) for r in tracks.gaps(p).collect()] == [(2, 5, 2)]
    assert tracks.segments(p).count() == 3 and tracks.segments(p, 3).count() == 4
    t = {r.track_id: [q.frame_index for q in r.points] for r in tracks.trajectories(p).collect()}
    assert t == {1: [1, 2, 5], 2: [3, 4, 5]}
    with pytest.raises(ValueError):
        tracks.timestamp(F.col("frame_index"), 0)
    assert [q.frame_index for q in tracks.trajectory(p, "s", 1).first().points] == [1, 2, 5]
    with pytest.raises(KeyError):
        tracks.trajectory(p, "s", 3)


def test_repeated_frames(spark):
    p = points(spark, [(1, f, 0, 0) for f in (1, 2, 2, 4)] + [(2, f, 0, 0) for f in (7, 8)])
    # four rows over four frames, of which one is missing
    assert {r.track_id: (r.n_points, r.has_gaps) for r in tracks.bounds(p).collect()} == {1: (4, True), 2: (2, False)}
    with pytest.raises(Exception, match="two points in a frame"):
        tracks.trajectories(p).collect()
    assert [r.track_id for r in tracks.trajectories(p, "quarantine").collect()] == [2]
    assert [(r.track_id, r.frame_index) for r in tracks.duplicates(p).collect()] == [(1, 2)]


def test_another_foot_point(spark):
    box = "seq_id string, track_id int, frame_index int, bb_left double, bb_top double, bb_width double, bb_height double, confidence double"
    df = spark.createDataFrame([("s", 1, 1, 10.0, 20.0, 4.0, 8.0, 0.5)], box)
    middle = tracks.footpoints(df, point=lambda x1, y1, x2, y2: ((x1 + x2) / 2, (y1 + y2) / 2)).first()
    assert (middle.x, middle.y) == (12.0, 24.0)


def test_image_heatmap(spark):
    rows = [(1, i, x, 0) for i, x in enumerate((49.9, 50, 1899.9, 1900, 1919.9))] + [(2, i, 0, y) for i, y in enumerate((49.9, 50, 1049.9, 1050, 1079.9))]
    cells = heatmaps.image_cells(points(spark, rows), ImageGrid(1920, 1080, 50))
    got = {(r.row, r.col): r.weight for r in heatmaps.accumulate(cells).collect()}
    assert got == {(0, 0): 2, (0, 1): 1, (0, 37): 1, (0, 38): 2, (1, 0): 1, (20, 0): 1, (21, 0): 2}
    out = points(spark, [(1, 1, -1, 50), (1, 2, 50, -10), (1, 3, 100, 50), (1, 4, 50, 100), (1, 5, math.nan, 1), (1, 6, 1, math.inf)])
    states = {r.status: r.n_points for r in heatmaps.status_counts(heatmaps.image_cells(out, ImageGrid(100, 100, 10))).collect()}
    assert states == {"out_of_bounds": 4, "invalid": 2}
    explicit = heatmaps.image_cells(points(spark, [(1, 1, 99.9, 49.9), (1, 2, 0, 0)]), ImageGrid(100, 50, None, 4, 2))
    assert {(r.row, r.col) for r in explicit.collect()} == {(1, 3), (0, 0)}


GROUND = "seq_id string, track_id int, frame_index int, x double, y double, is_valid boolean, is_extrapolated boolean, error_code string"


def test_ground_heatmap(spark):
    rows = [(1, 1.0, 1.0, True, False), (2, 9.0, 9.0, True, False), (3, 10.0, 10.0, True, True), (4, 15.0, 5.0, True, True), (5, math.nan, math.nan, False, False)]
    df = spark.createDataFrame([("s", 1, f, x, y, v, e, None if v else "NON_FINITE_INPUT") for f, x, y, v, e in rows], GROUND)
    cells = heatmaps.ground_cells(df, GroundGrid(0, 10, 0, 10, 2))
    assert {(r.row, r.col): r.weight for r in heatmaps.accumulate(cells).collect()} == {(0, 0): 1, (4, 4): 2}
    assert {r.status: r.n_points for r in heatmaps.status_counts(cells).collect()} == {"accumulated": 3, "out_of_bounds": 1, "invalid": 1}
    strict = heatmaps.status_counts(heatmaps.ground_cells(df, GroundGrid(0, 10, 0, 10, 2, False)))
    assert {r.status: r.n_points for r in strict.collect()} == {"accumulated": 2, "extrapolated_rejected": 2, "invalid": 1}
    assert [r.n_points for r in ground.error_codes(df).collect()] == [1]
    d = ground.diagnostics(df, False).first()
    assert (d.total, d.in_roi, d.extrapolated, d.invalid, d.accepted, d.excluded) == (5, 2, 2, 1, 2, 3)
    wide = spark.createDataFrame([("s", 1, i, x, y, True, False, None) for i, (x, y) in enumerate([(-19.0, -9.0), (0.0, 0.0), (20.0, 10.0), (-25.0, 0.0), (0.0, 15.0)])], GROUND)
    assert {r.status: r.n_points for r in heatmaps.status_counts(heatmaps.ground_cells(wide, GroundGrid(-20, 20, -10, 10, 2))).collect()} == {"accumulated": 3, "out_of_bounds": 2}


def test_zone_order_and_policy(spark):
    same = Zones.of(*[Zone.box(z, 0, 0, 10, 10) for z in ("Gamma", "Alpha", "Beta")])
    p = points(spark, [(1, 1, 5, 5), (1, 2, 50, 50)])
    assert [r.zone_ids for r in zones.memberships(p, same).orderBy("frame_index").collect()] == [["Alpha", "Beta", "Gamma"], []]
    g = spark.createDataFrame([("s", 1, 1, 5.0, 5.0, True, True, None), ("s", 1, 2, math.nan, 5.0, False, False, "X")], GROUND)
    assert [len(r.zone_ids) for r in zones.ground_memberships(g, same).orderBy("frame_index").collect()] == [3, 0]
    assert [len(r.zone_ids) for r in zones.ground_memberships(g, same, False).orderBy("frame_index").collect()] == [0, 0]


def test_conservation_can_fail(spark):
    p = points(spark, [(1, f, 10 * f, 500) for f in range(1, 9)])
    g = ground.project(p, presets.CALIBRATION_09)
    m, gm = zones.memberships(p, presets.ZONES_09), zones.ground_memberships(g, presets.GROUND_09)
    cells, gcells = heatmaps.image_cells(p, presets.CANVAS), heatmaps.ground_cells(g, presets.GRID_09)
    v, gv = zones.visits(m, presets.DWELL), zones.visits(gm, presets.DWELL)
    assert all(r.passed for r in audit.conservation(p, g, cells, gcells, m, gm, v, gv).collect())
    lost = [r.passed for r in audit.conservation(p, g.filter("frame_index > 2"), cells, gcells, m, gm, v, gv).collect()]
    assert lost.count(False) == 3


def test_reproducibility(spark):
    one = spark.createDataFrame([(0.654321, 5)], "mota double, n long")
    diff = lambda x, n: [(r.path, r.difference) for r in audit.reproducibility(audit.unpivot(one), audit.unpivot(spark.createDataFrame([(x, n)], "mota double, n long"))).collect()]
    assert diff(0.654322, 5) == [] and diff(0.654421, 5) == [("mota", "FLOAT_TOLERANCE_EXCEEDED")] and diff(0.654321, 6) == [("n", "EXACT_MISMATCH")]
    told = audit.markdown("t", [audit.sequence_markdown("A", {"a": one}), audit.sequence_markdown("B", {"detection": one}, seconds={"tracks": 2.0}, frames=50, rss_mb=9.0)])
    assert told.startswith("# t") and "## A" in told and "## B" in told and "mota" in told and "25.00 frames/s" in told and "9.0 MB" in told
    assert audit.peak_rss_mb() > 10
    assert audit.report_path("r", "all").endswith("EVALUATION_REPORT.md") and audit.report_path("r", "CAM-09-A").endswith("_CAM_09.md")
