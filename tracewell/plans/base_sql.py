"""DuckDB common table expressions that mirror the adapters and operators, written apart from them."""

from __future__ import annotations

from tracewell.config import Zones
from tracewell.functions.geometry import edges
from tracewell.functions.homography import Calibration
from tracewell.plans import presets


def _edge_rows(zones: Zones) -> str:
    rows = [f"('{z}', {', '.join(f'CAST({v!r} AS DOUBLE)' for v in e)})" for z in zones.ids for e in edges(zones.get(z).vertices)]
    return ", ".join(rows)


def members_sql(points: str, zones: Zones, name: str, inclusive: bool = True) -> str:
    """CTEs <name>_hit (track_id, frame_index, zone_id) and <name> (…, zone_ids): points against a table of edges."""
    border = "bool_or(p.x BETWEEN least(x1, x2) - 1e-7 AND greatest(x1, x2) + 1e-7 AND p.y BETWEEN least(y1, y2) - 1e-7 AND greatest(y1, y2) + 1e-7 AND abs((x2 - x1) * (y1 - p.y) - (x1 - p.x) * (y2 - y1)) / sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) <= 1e-7)"
    odd = "sum(CASE WHEN (y1 > p.y) <> (y2 > p.y) AND p.x < x1 + (p.y - y1) * (x2 - x1) / (y2 - y1) THEN 1 ELSE 0 END) % 2 = 1"
    inside = f"({border} OR {odd})" if inclusive else f"(NOT {border} AND {odd})"
    return f"""{name}_edges(zone_id, x1, y1, x2, y2) AS (VALUES {_edge_rows(zones)}),
    {name}_hit AS (SELECT p.track_id, p.frame_index, e.zone_id FROM {points} p, {name}_edges e WHERE isfinite(p.x) AND isfinite(p.y) GROUP BY 1, 2, 3 HAVING {inside}),
    {name} AS (SELECT p.track_id, p.frame_index, p.x, p.y, coalesce(h.ids, []) AS zone_ids FROM {points} p
      LEFT JOIN (SELECT track_id, frame_index, list(zone_id ORDER BY zone_id) AS ids FROM {name}_hit GROUP BY 1, 2) h USING (track_id, frame_index))"""


def visits_sql(members: str, name: str, gap: int) -> str:
    """CTE <name> of dwell visits, by numbering observations of a track and islands of a zone."""
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_index) AS k FROM {members}),
    {name}_z AS (SELECT track_id, frame_index, k, unnest(zone_ids) AS zone_id FROM {name}_n),
    {name}_l AS (SELECT *, lag(k) OVER w AS pk, lag(frame_index) OVER w AS pf FROM {name}_z WINDOW w AS (PARTITION BY track_id, zone_id ORDER BY frame_index)),
    {name}_i AS (SELECT *, sum(CASE WHEN pk = k - 1 AND frame_index - pf - 1 <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY track_id, zone_id ORDER BY frame_index) AS island FROM {name}_l),
    {name} AS (SELECT track_id, zone_id, min(frame_index) AS entry_frame, max(frame_index) AS last_observed_frame, count(*) AS observation_count FROM {name}_i GROUP BY track_id, zone_id, island)"""


def ground_sql(points: str, name: str, c: Calibration) -> str:
    """CTE <name>: points projected to the ground."""
    h = [[f"CAST({v!r} AS DOUBLE)" for v in row] for row in c.forward]
    lin = [f"(({r[0]} * x + {r[1]} * y) + {r[2]})" for r in h]
    crosses = [f"(({x2!r} - {x1!r}) * (y - {y1!r}::DOUBLE) - ({y2!r} - {y1!r}) * (x - {x1!r}::DOUBLE))" for x1, y1, x2, y2 in edges(c.region)]
    out = f"(({' OR '.join(f'{k} >= 1e-9' for k in crosses)}) AND ({' OR '.join(f'{k} <= -1e-9' for k in crosses)}))"
    return f"""{name}_w AS (SELECT *, {lin[0]} AS u, {lin[1]} AS v, {lin[2]} AS w, {out} AS outside FROM {points}),
    {name} AS (SELECT track_id, frame_index, CASE WHEN w > 1e-7 THEN u / w ELSE 'NaN'::DOUBLE END AS x, CASE WHEN w > 1e-7 THEN v / w ELSE 'NaN'::DOUBLE END AS y,
      w > 1e-7 AS is_valid, w > 1e-7 AND outside AS is_extrapolated, CASE WHEN NOT w > 1e-7 THEN 'PROJECTIVE_DENOMINATOR_TOO_SMALL' END AS error_code, x AS source_x, y AS source_y FROM {name}_w)"""


_OBS = """b AS (SELECT event_id, CAST(user_id AS INTEGER) AS track_id, event_type, CAST(floor((epoch_us(ts) - 1704067200000000) / 21600000000.0) + 1 AS INTEGER) AS frame_index FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY track_id, frame_index ORDER BY event_id) AS r FROM b),
    obs AS (SELECT track_id, frame_index, event_id, event_type, ((track_id * 131 + frame_index * 17) % 2000) - 40.0::DOUBLE + (event_id % 10) / 10.0::DOUBLE AS x, ((track_id * 71 + frame_index * 5) % 1150) - 20.0::DOUBLE AS y FROM o WHERE r = 1)"""
_TRACKS = """t0 AS (SELECT *, CAST(40 + 4 * (event_id % 5) AS DOUBLE) AS w FROM obs),
    tracks AS (SELECT track_id, frame_index, event_id, event_type, x - w / 2 AS bb_left, y - 2 * w AS bb_top, w AS bb_width, 2 * w AS bb_height, ((event_id * 37) % 100) / 100.0::DOUBLE AS confidence FROM t0),
    dets AS (SELECT frame_index, CAST(row_number() OVER (PARTITION BY frame_index ORDER BY event_id) AS INTEGER) AS det_idx, event_id, track_id, bb_left + ((event_id % 7) - 3) * 8 AS bb_left, bb_top + ((event_id % 7) - 3) * 8 AS bb_top, bb_width, bb_height, confidence FROM tracks),
    gt AS (SELECT frame_index AS frame, track_id, CAST(row_number() OVER (PARTITION BY frame_index ORDER BY event_id) AS INTEGER) AS gt_idx, bb_left, bb_top, bb_width, bb_height,
      CASE WHEN event_id % 10 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS conf, CASE WHEN event_type = 'error' THEN 7 ELSE 1 END AS class_id, (event_id % 100) / 100.0::DOUBLE AS visibility FROM tracks)"""
_FOOT = "foot AS (SELECT track_id, frame_index, (bb_left + (bb_left + bb_width)) / 2 AS x, bb_top + bb_height AS y, confidence FROM tracks)"


def pairs_sql(left: str, lkey: str, lframe: str, right: str, rkey: str, rframe: str, name: str) -> str:
    """CTE <name>: overlapping boxes of a frame with their IoU."""
    return f"""{name}_o AS (SELECT l.{lframe} AS frame_index, {lkey}, {rkey}, least(l.bb_left + l.bb_width, r.bb_left + r.bb_width) - greatest(l.bb_left, r.bb_left) AS ow, least(l.bb_top + l.bb_height, r.bb_top + r.bb_height) - greatest(l.bb_top, r.bb_top) AS oh,
      (l.bb_left + l.bb_width - l.bb_left) * (l.bb_top + l.bb_height - l.bb_top) AS la, (r.bb_left + r.bb_width - r.bb_left) * (r.bb_top + r.bb_height - r.bb_top) AS ra FROM {left} l JOIN {right} r ON l.{lframe} = r.{rframe}),
    {name} AS (SELECT frame_index, {lkey.split(' AS ')[-1].split('.')[-1]}, {rkey.split(' AS ')[-1].split('.')[-1]}, (ow * oh) / (la + ra - ow * oh) AS iou FROM {name}_o WHERE ow > 0 AND oh > 0)"""


PARTS = [
    _OBS, _TRACKS, _FOOT,
    "active AS (SELECT * FROM gt WHERE class_id = 1 AND conf = 1.0)",
    members_sql("foot", presets.ZONES_09, "im"), members_sql("foot", presets.SHAPES, "sh"), members_sql("foot", presets.SHAPES, "she", False),
    ground_sql("foot", "gr", presets.CALIBRATION_09),
    "gin AS (SELECT * FROM gr WHERE is_valid)", members_sql("gin", presets.GROUND_09, "gm0"),
    "gm AS (SELECT g.*, coalesce(m.zone_ids, []) AS zone_ids FROM gr g LEFT JOIN gm0 m USING (track_id, frame_index))",
    "gms AS (SELECT * REPLACE (CASE WHEN is_extrapolated THEN [] ELSE zone_ids END AS zone_ids) FROM gm)",
    visits_sql("im", "v0", 0), visits_sql("im", "v1", 1), visits_sql("im", "v2", 2), visits_sql("gm", "gv", 0),
    """hc AS (SELECT *, CASE WHEN NOT (isfinite(x) AND isfinite(y)) THEN 'invalid' WHEN x < 0 OR x >= 1920 OR y < 0 OR y >= 1080 THEN 'out_of_bounds' ELSE 'accumulated' END AS status FROM foot),
    hg AS (SELECT CAST(floor(y / 50) AS INTEGER) AS row, CAST(floor(x / 50) AS INTEGER) AS col, CAST(count(*) AS DOUBLE) AS weight FROM hc WHERE status = 'accumulated' GROUP BY 1, 2)""",
    """gc AS (SELECT *, CASE WHEN NOT is_valid THEN 'invalid' WHEN x < 0 OR x > 20 OR y < 0 OR y > 8 THEN 'out_of_bounds' ELSE 'accumulated' END AS status FROM gr),
    gcc AS (SELECT *, CASE WHEN abs(y - 8) <= greatest(1e-9 * greatest(abs(y), 8), 1e-9) THEN 15 ELSE CAST(least(greatest(floor((y - 0.0) / 0.5), 0), 15) AS INTEGER) END AS row,
      CASE WHEN abs(x - 20) <= greatest(1e-9 * greatest(abs(x), 20), 1e-9) THEN 39 ELSE CAST(least(greatest(floor((x - 0.0) / 0.5), 0), 39) AS INTEGER) END AS col FROM gc WHERE status = 'accumulated')""",
    pairs_sql("dets", "l.det_idx", "frame_index", "active", "r.gt_idx", "frame", "dp"),
    pairs_sql("tracks", "l.track_id AS track_id", "frame_index", "active", "r.track_id AS gt_id", "frame", "tp"),
]


def over(select: str, *more: str) -> str:
    """The common expressions, and more of them, in front of a SELECT. Unused ones cost nothing."""
    return "WITH RECURSIVE " + ",\n".join([*PARTS, *more]) + "\n" + select
