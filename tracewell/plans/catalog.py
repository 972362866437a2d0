"""Registry of the queries over trajectories, zones and matching, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.config import Dwell, Tracker, Zone, Zones
from tracewell.functions import geometry, homography
from tracewell.operators import audit, ground, heatmaps, matching, tracking, tracks, zones
from tracewell.plans import presets
from tracewell.plans.base_sql import over, visits_sql
from tracewell.sources import adapters, detectors, files, sequences
from tracewell.streaming import replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
C09 = presets.CALIBRATION_09


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def T(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.tracks(adapters.observations(spark, sf))


def FOOT(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.footpoints(T(spark, sf))


def DET(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.detections(T(spark, sf))


def GT(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.ground_truth(T(spark, sf))


def ACTIVE(spark: SparkSession, sf: str) -> DataFrame:
    return matching.active_pedestrians(GT(spark, sf)).withColumnRenamed("frame", "frame_index")


def GROUND(spark: SparkSession, sf: str) -> DataFrame:
    return ground.project(FOOT(spark, sf), C09)


def MEMBERS(spark: SparkSession, sf: str) -> DataFrame:
    return zones.memberships(FOOT(spark, sf), presets.ZONES_09)


def GMEMBERS(spark: SparkSession, sf: str) -> DataFrame:
    return zones.ground_memberships(GROUND(spark, sf), presets.GROUND_09)


def VISITS(spark: SparkSession, sf: str, gap: int = 0) -> DataFrame:
    return zones.visits(MEMBERS(spark, sf), Dwell(presets.FPS, gap))


def GVISITS(spark: SparkSession, sf: str) -> DataFrame:
    return zones.visits(GMEMBERS(spark, sf), presets.DWELL)


def DPAIRS(spark: SparkSession, sf: str) -> DataFrame:
    return matching.box_pairs(DET(spark, sf), ACTIVE(spark, sf), ["det_idx"], ["gt_idx"])


def TPAIRS(spark: SparkSession, sf: str) -> DataFrame:
    return matching.box_pairs(T(spark, sf), ACTIVE(spark, sf).withColumnRenamed("track_id", "gt_id"), ["track_id"], ["gt_id"])


def ids(column: str = "zone_ids"):
    return F.array_join(column, ",").alias("zone_ids")


# --- sources -----------------------------------------------------------------


def WRITTEN(spark: SparkSession, sf: str) -> sequences.Sequence:
    """The events as a sequence directory: an INI file and comma-separated rows, written and scanned again."""
    gt, det = GT(spark, sf), DET(spark, sf).select(F.col("frame_index").alias("frame"), F.lit(-1).alias("track_id"), "bb_left", "bb_top", "bb_width", "bb_height", F.col("confidence").alias("conf"))
    last = gt.agg(F.max("frame")).first()[0]
    info = sequences.Info("events", "img1", presets.FPS, last or 1, presets.CANVAS.width, presets.CANVAS.height, ".png")
    return sequences.write(spark, files.shared_folder(spark), info, gt, det)


@query(over("SELECT frame, track_id, bb_left, visibility FROM gt WHERE class_id = 1 AND conf = 1.0 AND visibility >= 0.25"))
def gt_scan_filtered(spark, sf):
    return WRITTEN(spark, sf).ground_truth(True, True, 0.25).select("frame", "track_id", "bb_left", "visibility")


@query(over("SELECT frame_index AS frame, bb_left, bb_top, confidence AS conf FROM dets WHERE confidence >= 0.4"))
def det_scan_min_conf(spark, sf):
    return WRITTEN(spark, sf).detections(0.4).select("frame", "bb_left", "bb_top", "conf")


@query(over("SELECT DISTINCT frame_index, 'img1/' || lpad(CAST(frame_index AS VARCHAR), 6, '0') || '.jpg' AS path FROM obs"))
def frame_paths(spark, sf):
    f = adapters.observations(spark, sf).select("frame_index").distinct()
    return f.withColumn("path", sequences.frame_path(F.lit("img1"), F.col("frame_index"), F.lit(".jpg")))


@query(over("SELECT count(*) AS total_annotations, count(*) FILTER (class_id = 1 AND conf = 1.0) AS active_pedestrians, count(DISTINCT track_id) FILTER (class_id = 1 AND conf = 1.0) AS pedestrian_tracks FROM gt"))
def sequence_summary(spark, sf):
    return sequences.summary_of(GT(spark, sf))


@query(over("SELECT frame_index, count(*) AS n_rows FROM obs WHERE frame_index BETWEEN 5 AND 110 AND (frame_index - 5) % 7 = 0 GROUP BY 1"))
def frame_range_stride(spark, sf):
    wanted = sequences.frame_range(spark, 110, 5, 400, 7)
    return adapters.observations(spark, sf).join(wanted, "frame_index").groupBy("frame_index").agg(F.count("*").alias("n_rows"))


@query(over("SELECT frame_index, track_id FROM obs WHERE frame_index <= 40"))
def frame_limit(spark, sf):
    return sequences.limit_frames(adapters.observations(spark, sf), 40, 120).select("frame_index", "track_id")


@query(over("SELECT 'events' AS name, 'img1' AS im_dir, 30.0::DOUBLE AS frame_rate, max(frame_index) AS seq_length, 1920 AS im_width, 1080 AS im_height, '.png' AS im_ext FROM obs"))
def seqinfo(spark, sf):
    return WRITTEN(spark, sf).metadata()


@query(over("SELECT frame_index, CAST(1 AS INTEGER) AS det_idx, CAST(frame_index * 10 AS DOUBLE) AS bb_left, 0.9::DOUBLE AS confidence FROM (SELECT DISTINCT frame_index FROM obs)"))
def detect_plugin(spark, sf):
    def make():
        return lambda frame, content: [(frame * 10.0, 5.0, frame * 10.0 + 40.0, 85.0, 0.9), (0.0, 0.0, 9.0, 9.0, 0.2)]

    frames = adapters.observations(spark, sf).select("seq_id", "frame_index").distinct()
    return detectors.detect(frames, make, 0.5).select("frame_index", "det_idx", "bb_left", "confidence")


# --- projections ---------------------------------------------------------------


@query(over("""SELECT name, count(*) AS n_rows FROM (SELECT coalesce(['Pedestrian', 'Person On Vehicle', 'Car', 'Bicycle', 'Motorbike', 'Non Motorized Vehicle', 'Static Person', 'Distractor', 'Occluder',
    'Occluder On The Ground', 'Occluder Full', 'Reflection'][i], 'Unknown (' || i || ')') AS name FROM (SELECT event_id % 15 AS i FROM tracks)) GROUP BY 1"""))
def class_names(spark, sf):
    """Rows of each class, where a row's class follows from its event."""
    return T(spark, sf).select(sequences.class_name((F.col("event_id") % 15).cast("int")).alias("name")).groupBy("name").agg(F.count("*").alias("n_rows"))


@query(over("SELECT frame, track_id, gt_idx FROM active"))
def gt_active_ped(spark, sf):
    return matching.active_pedestrians(GT(spark, sf)).select("frame", "track_id", "gt_idx")


@query(over("SELECT track_id, frame_index, bb_left AS x1, bb_top AS y1, bb_left + bb_width AS x2, bb_top + bb_height AS y2 FROM tracks"))
def bbox_xyxy(spark, sf):
    return tracks.corners(T(spark, sf)).select("track_id", "frame_index", "x1", "y1", "x2", "y2")


@query(over("SELECT track_id, frame_index, greatest(0.0::DOUBLE, bb_width - 50) * greatest(0.0::DOUBLE, bb_height - 110) AS area FROM tracks"))
def bbox_area(spark, sf):
    return T(spark, sf).select("track_id", "frame_index", geometry.clamped_area(F.col("bb_width") - 50, F.col("bb_height") - 110).alias("area"))


@query(over("SELECT track_id, frame_index, x, y, confidence FROM foot"))
def footpoints(spark, sf):
    return FOOT(spark, sf).drop("seq_id")


@query(over("SELECT track_id, frame_index, (frame_index - 1) / 30.0::DOUBLE AS seconds FROM obs"))
def timestamps(spark, sf):
    return adapters.observations(spark, sf).select("track_id", "frame_index", tracks.timestamp(F.col("frame_index"), presets.FPS).alias("seconds"))


@query(over("SELECT track_id, frame_index, x, y, is_valid, is_extrapolated, error_code, source_x, source_y FROM gr"))
def ground_project(spark, sf):
    return GROUND(spark, sf).drop("seq_id", "frame")


def _inverse_sql() -> str:
    h = [[f"CAST({v!r} AS DOUBLE)" for v in row] for row in C09.backward]
    lin = [f"(({r[0]} * x + {r[1]} * y) + {r[2]})" for r in h]
    return over(f"SELECT track_id, frame_index, round({lin[0]} / {lin[2]}, 6) AS image_x, round({lin[1]} / {lin[2]}, 6) AS image_y FROM gr")


@query(_inverse_sql())
def ground_to_image(spark, sf):
    g = GROUND(spark, sf).withColumn("p", C09.to_image(F.col("x"), F.col("y")))
    return g.select("track_id", "frame_index", F.round("p.x", 6).alias("image_x"), F.round("p.y", 6).alias("image_y"))


@query(over("SELECT track_id, frame_index, NOT outside AS in_roi FROM gr_w"))
def roi_flag(spark, sf):
    return FOOT(spark, sf).select("track_id", "frame_index", geometry.in_convex(F.col("x"), F.col("y"), C09.region).alias("in_roi"))


@query(over("SELECT track_id, frame_index, source_x, source_y, error_code FROM gr WHERE NOT is_valid"))
def projection_quarantine(spark, sf):
    return ground.quarantined(GROUND(spark, sf)).drop("seq_id")


# --- geometry ---------------------------------------------------------------------


@query(over("SELECT track_id, frame_index, list_contains(s.zone_ids, 'Shape_L') AS in_l, list_contains(s.zone_ids, 'Shape_Triangle') AS in_triangle, list_contains(e.zone_ids, 'Shape_L') AS within_l FROM sh s JOIN she e USING (track_id, frame_index)"))
def point_in_polygon(spark, sf):
    x, y = F.col("x"), F.col("y")
    ell, tri = (presets.SHAPES.get(z).vertices for z in ("Shape_L", "Shape_Triangle"))
    return FOOT(spark, sf).select("track_id", "frame_index", geometry.contains(x, y, ell).alias("in_l"), geometry.contains(x, y, tri).alias("in_triangle"), geometry.contains(x, y, ell, False).alias("within_l"))


@query(over("""SELECT track_id, frame_index,
    ((d1 > 1e-9 AND d2 < -1e-9) OR (d1 < -1e-9 AND d2 > 1e-9)) AND ((d3 > 1e-9 AND d4 < -1e-9) OR (d3 < -1e-9 AND d4 > 1e-9)) AS crosses
    FROM (SELECT track_id, frame_index, (432 - y1) * (x2 - x1) - (y2 - y1) * (384 - x1) AS d1, (918 - y1) * (x2 - x1) - (y2 - y1) * (1536 - x1) AS d2, (y1 - 432) * (1536 - 384) - (918 - 432) * (x1 - 384) AS d3, (y2 - 432) * (1536 - 384) - (918 - 432) * (x2 - 384) AS d4
    FROM (SELECT track_id, frame_index, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM foot WINDOW w AS (PARTITION BY track_id ORDER BY frame_index)) WHERE x2 IS NOT NULL)"""))
def segments_intersect(spark, sf):
    s = tracks.segments(FOOT(spark, sf), 10**6)
    p = [(F.col("x"), F.col("y")), (F.col("next_x"), F.col("next_y")), (F.lit(384.0), F.lit(432.0)), (F.lit(1536.0), F.lit(918.0))]
    return s.select("track_id", "frame_index", geometry.crosses(p).alias("crosses"))


@query(over("SELECT zone_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM (SELECT * FROM im_edges UNION ALL SELECT * FROM sh_edges) GROUP BY zone_id"))
def zone_area(spark, sf):
    held = [presets.ZONES_09, presets.SHAPES]
    rows = [(z, [(float(x), float(y)) for x, y in r.get(z).vertices]) for r in held for z in r.ids]
    return spark.createDataFrame(rows, "zone_id string, vertices array<struct<x:double,y:double>>").select("zone_id", geometry.area_of(F.col("vertices")).alias("area"))


def _turn(a: str, b: str, c: str) -> str:
    """SQL for the sign of a turn, 0 within the tolerance."""
    v = f"({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x)"
    return f"(CASE WHEN {v} > 1e-9 THEN 1 WHEN {v} < -1e-9 THEN -1 ELSE 0 END)"


def _cross_sql(a: str, b: str, c: str, d: str) -> str:
    return f"({_turn(a, b, c)} * {_turn(a, b, d)} = -1 AND {_turn(c, d, a)} * {_turn(c, d, b)} = -1)"


_SAME = " OR ".join(f"({a}x = {b}x AND {a}y = {b}y)" for a, b in ("kl", "lm", "mn", "nk"))
_QUADS = "SELECT track_id, " + ", ".join(f"p[{k}][1] AS {c}x, p[{k}][2] AS {c}y" for k, c in enumerate("klmn", 1)) + " FROM (SELECT track_id, list([x, y] ORDER BY frame_index) AS p FROM foot GROUP BY 1 HAVING count(*) >= 4)"


@query(over(f"SELECT track_id, NOT ({_SAME}) AND NOT {_cross_sql('k', 'l', 'm', 'n')} AND NOT {_cross_sql('l', 'm', 'n', 'k')} AND abs((kx - mx) * (ly - ny) - (lx - nx) * (ky - my)) / 2 > 1e-6 AS valid FROM q", f"q AS ({_QUADS})"))
def zone_validate(spark, sf):
    """Whether the first four points of a track, in order, make a zone."""

    def run(batches):
        for pdf in batches:
            pdf["valid"] = [valid([(v["x"], v["y"]) for v in p]) for p in pdf["points"]]
            yield pdf[["track_id", "valid"]]

    def valid(v) -> bool:
        try:
            Zone("z", tuple(v))
        except ValueError:
            return False
        return True

    quads = tracks.trajectories(FOOT(spark, sf)).filter(F.size("points") >= 4).select("track_id", F.slice("points", 1, 4).alias("points"))
    return quads.mapInPandas(run, "track_id int, valid boolean")


@query("SELECT * FROM (VALUES (" + "), (".join(f"{i}, {j}, round({m[i][j]!r}::DOUBLE, 6)" for m in [presets.MATRIX_09] for i in range(3) for j in range(3)) + ")) t(row, col, value)")
def homography_09(spark, sf):
    """The published matrix, estimated anew from where it puts six places that lie among the foot points."""
    shares = {"x": [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], "y": [0.5, 0.1, 0.9, 0.05, 1.0, 0.3]}
    at = FOOT(spark, sf).agg(*[F.percentile(c, F.lit(q)).alias(c) for c, q in shares.items()]).first()
    places = spark.createDataFrame([("s", 0, 0, float(x), float(y)) for x, y in zip(at.x, at.y, strict=True)], "seq_id string, track_id int, frame_index int, x double, y double")
    pairs = [((r.source_x, r.source_y), (r.x, r.y)) for r in ground.project(places, C09).collect()]  # six rows
    h = homography.estimate([p for p, _ in pairs], [q for _, q in pairs])
    return spark.createDataFrame([(i, j, float(h[i, j])) for i in range(3) for j in range(3)], "row int, col int, value double").withColumn("value", F.round("value", 6) + 0.0)


@query("""WITH p(ix, iy, gx, gy) AS (VALUES (200.0::DOUBLE, 550.0::DOUBLE, 0.0::DOUBLE, 8.0::DOUBLE), (1500, 550, 20, 8), (1750, 950, 20, 0), (150, 950, 0, 0)),
    w AS (SELECT *, 0.0008450704225352128 * iy + 1 AS w FROM p), e AS (SELECT sqrt(pow((0.022535211267605642 * ix + 0.002816901408450706 * iy - 6.056338028169014) / w - gx, 2) + pow((-0.029295774647887334 * iy + 27.830985915492967) / w - gy, 2)) AS e FROM w)
    SELECT round(avg(e), 9) AS mean_error, round(median(e), 9) AS median_error, round(sqrt(avg(e * e)), 9) AS rmse, round(max(e), 9) AS max_error FROM e""")
def reprojection_error(spark, sf):
    p = spark.createDataFrame([(*a, *b) for a, b in presets.POINTS_09], "x double, y double, gx double, gy double")
    g = C09.project(F.col("x"), F.col("y"))
    e = p.select(F.sqrt((g["x"] - F.col("gx")) ** 2 + (g["y"] - F.col("gy")) ** 2).alias("e"))
    return e.agg(F.round(F.avg("e"), 9).alias("mean_error"), F.round(F.median("e"), 9).alias("median_error"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 9).alias("rmse"), F.round(F.max("e"), 9).alias("max_error"))


# --- zones and dwell ------------------------------------------------------------------


@query(over("SELECT track_id, frame_index, array_to_string(zone_ids, ',') AS zone_ids FROM im"))
def zone_membership(spark, sf):
    return MEMBERS(spark, sf).select("track_id", "frame_index", ids())


@query(over("SELECT track_id, frame_index, array_to_string(zone_ids, ',') AS zone_ids FROM gm"))
def ground_zone_membership(spark, sf):
    return GMEMBERS(spark, sf).select("track_id", "frame_index", ids())


@query(over("SELECT track_id, frame_index, array_to_string(zone_ids, ',') AS zone_ids FROM gms"))
def ground_zone_strict(spark, sf):
    return zones.ground_memberships(GROUND(spark, sf), presets.GROUND_09, False).select("track_id", "frame_index", ids())


@query(over("SELECT track_id, frame_index, len(zone_ids) > 0 AS is_in_zone, CASE WHEN len(zone_ids) = 1 THEN zone_ids[1] END AS primary_zone FROM im"))
def primary_zone(spark, sf):
    m = MEMBERS(spark, sf)
    return m.select("track_id", "frame_index", (F.size("zone_ids") > 0).alias("is_in_zone"), zones.primary_zone(F.col("zone_ids")).alias("primary_zone"))


@query(over("SELECT track_id, frame_index, unnest(list_filter(before, lambda z: NOT list_contains(zone_ids, z))) AS zone_id FROM (SELECT *, lag(zone_ids) OVER (PARTITION BY track_id ORDER BY frame_index) AS before FROM im)"))
def zone_exits(spark, sf):
    return zones.exits(MEMBERS(spark, sf)).drop("seq_id")


_VISIT = "track_id, zone_id, entry_frame, last_observed_frame, (entry_frame - 1) / 30.0::DOUBLE AS entry_timestamp, (last_observed_frame - 1) / 30.0::DOUBLE AS exit_timestamp, (last_observed_frame - entry_frame) / 30.0::DOUBLE AS duration_seconds, observation_count"


@query(over(f"SELECT {_VISIT} FROM v0"))
def dwell_visits_k0(spark, sf):
    return VISITS(spark, sf).drop("seq_id")


@query(over(f"SELECT {_VISIT} FROM v1"))
def dwell_visits_k1(spark, sf):
    return VISITS(spark, sf, 1).drop("seq_id")


@query(over(f"SELECT {_VISIT} FROM v2"))
def dwell_visits_k2(spark, sf):
    return VISITS(spark, sf, 2).drop("seq_id")


@query(over(f"SELECT {_VISIT} FROM gv"))
def ground_dwell_visits(spark, sf):
    return GVISITS(spark, sf).drop("seq_id")


@query(over(f"SELECT {_VISIT} FROM gvv", "gv1 AS (SELECT * FROM gm WHERE is_valid)", visits_sql("gv1", "gvv", 0)))
def ground_dwell_valid_only(spark, sf):
    """Visits over valid points alone: an invalid frame is a gap, not an observation outside."""
    return zones.visits(GMEMBERS(spark, sf).filter("is_valid"), presets.DWELL).drop("seq_id")


@query(over(f"SELECT {_VISIT} FROM v1 WHERE zone_id = 'Zone_Left'"))
def visits_for_zone(spark, sf):
    return VISITS(spark, sf, 1).filter("zone_id = 'Zone_Left'").drop("seq_id")


@query(over(f"SELECT {_VISIT} FROM v1 WHERE track_id = 7"))
def visits_for_track(spark, sf):
    return VISITS(spark, sf, 1).filter("track_id = 7").drop("seq_id")


_ANALYTICS = """SELECT z.zone_id, coalesce(n, 0) AS total_visits, coalesce(v, 0) AS unique_visitors, coalesce(s, 0) / 30.0::DOUBLE AS total_dwell_time, coalesce(s / 30.0::DOUBLE / n, 0) AS average_dwell_time,
    coalesce(m, 0) / 30.0::DOUBLE AS max_dwell_time, coalesce(o, 0) AS total_observations FROM (VALUES ('Zone_Central'), ('Zone_Left'), ('Zone_Nowhere')) z(zone_id)
    LEFT JOIN (SELECT zone_id, count(*) AS n, count(DISTINCT track_id) AS v, CAST(sum(last_observed_frame - entry_frame) AS BIGINT) AS s, max(last_observed_frame - entry_frame) AS m, CAST(sum(observation_count) AS BIGINT) AS o FROM v1 GROUP BY 1) a ON a.zone_id = z.zone_id"""


@query(over(_ANALYTICS))
def zone_analytics(spark, sf):
    far = Zones.of(*presets.ZONES_09.held.values(), Zone.box("Zone_Nowhere", 9000, 9000, 9100, 9100))
    return zones.zone_analytics(VISITS(spark, sf, 1), far, presets.DWELL)


@query(over("SELECT track_id, count(*) AS n_visits, string_agg(entry_frame || '@' || zone_id, ' ' ORDER BY entry_frame, zone_id) AS visits, CAST(sum(last_observed_frame - entry_frame) AS BIGINT) / 30.0::DOUBLE AS total_dwell_time, array_to_string(list(DISTINCT zone_id ORDER BY zone_id), ',') AS zones_visited FROM v1 GROUP BY track_id"))
def person_summary(spark, sf):
    p = zones.person_summary(VISITS(spark, sf, 1), presets.DWELL)
    told = F.array_join(F.transform("visits", lambda v: F.concat(v["entry_frame"].cast("string"), F.lit("@"), v["zone_id"])), " ")
    return p.select("track_id", F.size("visits").cast("long").alias("n_visits"), told.alias("visits"), "total_dwell_time", F.array_join("zones_visited", ",").alias("zones_visited"))


@query(over("SELECT f.frame_index, count(v.zone_id) AS active_visits FROM (SELECT DISTINCT frame_index FROM obs) f LEFT JOIN v2 v ON f.frame_index BETWEEN v.entry_frame AND v.last_observed_frame GROUP BY 1"))
def active_visits_at_frame(spark, sf):
    frames = adapters.observations(spark, sf).select("seq_id", "frame_index").distinct()
    return zones.active_visits(VISITS(spark, sf, 2), frames).drop("seq_id")


@query(over("SELECT count(*) AS total_visits, count(DISTINCT track_id) AS distinct_visitors, CAST(sum(last_observed_frame - entry_frame) AS BIGINT) / 30.0::DOUBLE AS total_seconds, CAST(sum(last_observed_frame - entry_frame) AS BIGINT) / 30.0::DOUBLE / count(*) AS average_seconds, max(last_observed_frame - entry_frame) / 30.0::DOUBLE AS max_seconds, count(*) FILTER (zone_id = 'Zone_Central') AS visits_central, count(*) FILTER (zone_id = 'Zone_Left') AS visits_left FROM v1"))
def dwell_diagnostics(spark, sf):
    span = F.col("last_observed_frame") - F.col("entry_frame")
    rate = F.lit(presets.FPS)
    each = [F.count_if(F.col("zone_id") == z).alias(f"visits_{z.split('_')[1].lower()}") for z in presets.ZONES_09.ids]
    return VISITS(spark, sf, 1).agg(F.count("*").alias("total_visits"), F.count_distinct("seq_id", "track_id").alias("distinct_visitors"), (F.sum(span) / rate).alias("total_seconds"), (F.sum(span) / rate / F.count("*")).alias("average_seconds"), (F.max(span) / rate).alias("max_seconds"), *each)


@query(over("SELECT count(*) AS total, count(*) FILTER (len(zone_ids) > 0) AS inside, count(*) FILTER (len(zone_ids) = 0) AS outside, count(*) FILTER (len(zone_ids) = 1) AS single, count(*) FILTER (len(zone_ids) > 1) AS multi FROM im"))
def zone_diagnostics(spark, sf):
    n = F.size("zone_ids")
    return MEMBERS(spark, sf).agg(F.count("*").alias("total"), F.count_if(n > 0).alias("inside"), F.count_if(n == 0).alias("outside"), F.count_if(n == 1).alias("single"), F.count_if(n > 1).alias("multi"))


# --- trajectories ----------------------------------------------------------------------


@query(over("SELECT track_id, count(*) AS n_points, string_agg(frame_index || ':' || CAST(CAST(y AS INTEGER) AS VARCHAR), ' ' ORDER BY frame_index) AS points FROM foot GROUP BY track_id"))
def trajectories(spark, sf):
    told = F.array_join(F.transform("points", lambda p: F.concat(p["frame_index"].cast("string"), F.lit(":"), F.round(p["y"]).cast("int").cast("string"))), " ")
    return tracks.trajectories(FOOT(spark, sf)).select("track_id", F.size("points").cast("long").alias("n_points"), told.alias("points"))


@query(over("SELECT track_id, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(*) AS n_points, max(frame_index) - min(frame_index) + 1 > count(*) AS has_gaps FROM foot GROUP BY 1"))
def trajectory_bounds(spark, sf):
    return tracks.bounds(FOOT(spark, sf)).drop("seq_id")


@query(over("SELECT track_id, pf AS previous_frame, frame_index, frame_index - pf - 1 AS gap_frames FROM (SELECT *, lag(frame_index) OVER (PARTITION BY track_id ORDER BY frame_index) AS pf FROM foot) WHERE frame_index - pf > 1"))
def trajectory_gaps(spark, sf):
    return tracks.gaps(FOOT(spark, sf)).drop("seq_id")


@query(over("SELECT user_id AS track_id, frame_index, count(*) AS n_rows FROM (SELECT user_id, b.frame_index FROM b JOIN events USING (event_id)) GROUP BY 1, 2 HAVING count(*) > 1"))
def duplicate_observations(spark, sf):
    e = adapters.events(spark, sf)
    frame = (F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / float(adapters.FRAME_US)) + 1).cast("int")
    return tracks.duplicates(e.select(F.lit("events").alias("seq_id"), F.col("user_id").alias("track_id"), frame.alias("frame_index"))).drop("seq_id")


@query(over("""SELECT (SELECT count(*) FROM l) AS total_trajectories, CAST((SELECT sum(n) FROM l) AS BIGINT) AS total_observations, (SELECT sum(n) / count(*) FROM l) AS mean_observations_per_track, (SELECT count(*) FILTER (life > n) FROM l) AS trajectories_with_gaps,
    (SELECT count(*) FROM g) AS total_gaps, (SELECT min(gap) FROM g) AS min_gap_frames, (SELECT max(gap) FROM g) AS max_gap_frames, (SELECT sum(gap) / count(*) FROM g) AS mean_gap_frames, (SELECT CAST(median(gap) AS DOUBLE) FROM g) AS median_gap_frames,
    (SELECT min(life) FROM l) AS min_lifespan_frames, (SELECT max(life) FROM l) AS max_lifespan_frames, (SELECT sum(life) / count(*) FROM l) AS mean_lifespan_frames, (SELECT CAST(median(life) AS DOUBLE) FROM l) AS median_lifespan_frames,
    (SELECT min(life) / 30.0::DOUBLE FROM l) AS min_lifespan_seconds, (SELECT max(life) / 30.0::DOUBLE FROM l) AS max_lifespan_seconds, (SELECT sum(life) / count(*) / 30.0::DOUBLE FROM l) AS mean_lifespan_seconds, (SELECT CAST(median(life) AS DOUBLE) / 30.0::DOUBLE FROM l) AS median_lifespan_seconds,
    (SELECT sum(n) / sum(life) FROM l) AS frame_coverage_ratio""",
    "l AS (SELECT track_id, count(*) AS n, max(frame_index) - min(frame_index) + 1 AS life FROM foot GROUP BY 1)", "g AS (SELECT frame_index - pf - 1 AS gap FROM (SELECT *, lag(frame_index) OVER (PARTITION BY track_id ORDER BY frame_index) AS pf FROM foot) WHERE frame_index - pf > 1)"))
def trajectory_stats(spark, sf):
    return tracks.summary(FOOT(spark, sf), presets.FPS)


@query(over("SELECT q.track_id, q.frame_index, f.x, f.y FROM (SELECT DISTINCT track_id, CAST(60 AS INTEGER) AS frame_index FROM obs) q LEFT JOIN foot f USING (track_id, frame_index)"))
def point_at_frame(spark, sf):
    p = FOOT(spark, sf)
    asked = p.select("seq_id", "track_id").distinct().withColumn("frame_index", F.lit(60))
    return tracks.point_at(p, asked).drop("seq_id")


@query(over("SELECT track_id, frame_index, x, y, nf AS next_frame, nx AS next_x, ny AS next_y FROM (SELECT *, lead(frame_index) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM foot WHERE frame_index <= 100 AND frame_index > 70 WINDOW w AS (PARTITION BY track_id ORDER BY frame_index)) WHERE nf - frame_index <= 2"))
def trajectory_segments(spark, sf):
    return tracks.segments(FOOT(spark, sf), 2, 100, 30).drop("seq_id")


@query(over("SELECT track_id, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(*) AS n_points, count(*) FILTER (is_extrapolated) AS extrapolated_count FROM gr WHERE is_valid GROUP BY 1"))
def ground_trajectories(spark, sf):
    return ground.trajectories(GROUND(spark, sf)).drop("seq_id")


@query(over("SELECT CASE WHEN w > 1e-7 THEN 'NONE' ELSE 'PROJECTIVE_DENOMINATOR_TOO_SMALL' END AS error_code, count(*) AS n_points FROM (SELECT 0.0008450704225352128 * (y - 1500) + 1 AS w FROM foot) WHERE NOT w > 1e-7 GROUP BY 1"))
def error_codes(spark, sf):
    """Points moved above the horizon, so that some cannot be projected."""
    return ground.error_codes(ground.project(FOOT(spark, sf).withColumn("y", F.col("y") - 1500), C09))


@query(over("SELECT count(*) AS total, count(*) FILTER (is_valid AND NOT is_extrapolated) AS in_roi, count(*) FILTER (is_extrapolated) AS extrapolated, count(*) FILTER (NOT is_valid) AS invalid, count(*) FILTER (is_valid AND NOT is_extrapolated) AS accepted, count(*) FILTER (NOT is_valid OR is_extrapolated) AS excluded FROM gr"))
def projection_diagnostics(spark, sf):
    return ground.diagnostics(GROUND(spark, sf), False)


@query(over("SELECT (SELECT count(*) FROM dets) AS detections, (SELECT count(*) FROM tracks) AS track_rows, (SELECT count(*) FROM foot) AS footpoints, (SELECT count(DISTINCT track_id) FROM foot) AS trajectories"))
def spatial_diagnostics(spark, sf):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    last = FOOT(spark, sf).agg(F.count("*").alias("footpoints"), F.count_distinct("seq_id", "track_id").alias("trajectories"))
    return one(DET(spark, sf), "detections").join(F.broadcast(one(T(spark, sf), "track_rows"))).join(F.broadcast(last))


@query(over("SELECT track_id, frame_index, x, y FROM foot WHERE frame_index = (SELECT max(frame_index) FROM foot)"))
def last_frame_state(spark, sf):
    p = FOOT(spark, sf)
    last = p.groupBy("seq_id").agg(F.max("frame_index").alias("frame_index"))
    return p.join(last, ["seq_id", "frame_index"]).select("track_id", "frame_index", "x", "y")


# --- heatmaps ------------------------------------------------------------------------------


@query(over("SELECT track_id, frame_index, status, CASE WHEN status = 'accumulated' THEN CAST(floor(y / 50) AS INTEGER) END AS row, CASE WHEN status = 'accumulated' THEN CAST(floor(x / 50) AS INTEGER) END AS col FROM hc"))
def heatmap_cells(spark, sf):
    return heatmaps.image_cells(FOOT(spark, sf), presets.CANVAS).select("track_id", "frame_index", "status", "row", "col")


@query(over("SELECT row, col, weight FROM hg"))
def image_heatmap(spark, sf):
    return heatmaps.accumulate(heatmaps.image_cells(FOOT(spark, sf), presets.CANVAS))


@query(over("SELECT status, count(*) AS n_points FROM hc GROUP BY 1"))
def heatmap_status(spark, sf):
    return heatmaps.status_counts(heatmaps.image_cells(FOOT(spark, sf), presets.CANVAS))


@query(over("SELECT row, col, weight / (SELECT max(weight) FROM hg) AS normalized FROM hg"))
def heatmap_normalized(spark, sf):
    return heatmaps.normalized(image_heatmap(spark, sf))


@query(over("SELECT (SELECT count(*) FILTER (status = 'accumulated') FROM hc) AS accumulated, (SELECT count(*) FILTER (status = 'out_of_bounds') FROM hc) AS out_of_bounds, (SELECT count(*) FILTER (status = 'invalid') FROM hc) AS invalid, count(*) AS occupied_cells, max(weight) AS max_cell, count(*) / 858.0::DOUBLE AS occupancy_ratio FROM hg"))
def heatmap_diagnostics(spark, sf):
    return heatmaps.diagnostics(heatmaps.image_cells(FOOT(spark, sf), presets.CANVAS), presets.CANVAS.shape)


@query(over("SELECT track_id, frame_index, row, col FROM gcc"))
def ground_heatmap_cells(spark, sf):
    return heatmaps.ground_cells(GROUND(spark, sf), presets.GRID_09).filter("status = 'accumulated'").select("track_id", "frame_index", "row", "col")


@query(over("SELECT row, col, CAST(count(*) AS DOUBLE) AS weight FROM gcc GROUP BY 1, 2"))
def ground_heatmap(spark, sf):
    return heatmaps.accumulate(heatmaps.ground_cells(GROUND(spark, sf), presets.GRID_09))


@query(over("SELECT status, count(*) AS n_points FROM gc GROUP BY 1"))
def ground_heatmap_status(spark, sf):
    return heatmaps.status_counts(heatmaps.ground_cells(GROUND(spark, sf), presets.GRID_09))


# --- matching ---------------------------------------------------------------------------------


@query(over("SELECT frame_index, det_idx, gt_idx, iou FROM dp"))
def iou_pairs(spark, sf):
    return DPAIRS(spark, sf).drop("seq_id")


@query(over("SELECT frame_index, det_idx, gt_idx, iou FROM dp WHERE iou >= 0.5"))
def iou_candidates(spark, sf):
    return DPAIRS(spark, sf).filter("iou >= 0.5").drop("seq_id")


def _greedy_sql(order: str) -> str:
    """CTEs r, s, m: candidates ranked within a frame and taken one by one."""
    return f"""r AS (SELECT frame_index, det_idx, gt_idx, row_number() OVER (PARTITION BY frame_index ORDER BY {order}) AS k FROM dp WHERE iou >= 0.5),
    s(frame_index, k, d, g, hit) AS (SELECT frame_index, k, [det_idx], [gt_idx], TRUE FROM r WHERE k = 1 UNION ALL
      SELECT s.frame_index, r.k, CASE WHEN list_contains(s.d, r.det_idx) OR list_contains(s.g, r.gt_idx) THEN s.d ELSE list_append(s.d, r.det_idx) END, CASE WHEN list_contains(s.d, r.det_idx) OR list_contains(s.g, r.gt_idx) THEN s.g ELSE list_append(s.g, r.gt_idx) END,
        NOT (list_contains(s.d, r.det_idx) OR list_contains(s.g, r.gt_idx)) FROM s JOIN r ON r.frame_index = s.frame_index AND r.k = s.k + 1),
    m AS (SELECT s.frame_index, r.det_idx, r.gt_idx FROM s JOIN r USING (frame_index, k) WHERE s.hit),
    c AS (SELECT coalesce(d.frame_index, a.frame_index) AS frame_index, coalesce(m.n, 0) AS tp, coalesce(d.n, 0) - coalesce(m.n, 0) AS fp, coalesce(a.n, 0) - coalesce(m.n, 0) AS fn
      FROM (SELECT frame_index, count(*) AS n FROM dets GROUP BY 1) d FULL JOIN (SELECT frame AS frame_index, count(*) AS n FROM active GROUP BY 1) a ON a.frame_index = d.frame_index LEFT JOIN (SELECT frame_index, count(*) AS n FROM m GROUP BY 1) m ON m.frame_index = coalesce(d.frame_index, a.frame_index))"""


_METRICS = "SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, sum(tp) / (sum(tp) + sum(fp)) AS precision, sum(tp) / (sum(tp) + sum(fn)) AS recall, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f1 FROM c"


@query(over("SELECT frame_index, det_idx, gt_idx FROM m", _greedy_sql("-iou, det_idx, gt_idx")))
def det_match_global_greedy(spark, sf):
    return matching.greedy_boxes(DET(spark, sf), ACTIVE(spark, sf)).drop("seq_id")


def _frames(spark, sf, in_order: bool) -> DataFrame:
    return matching.greedy_frames(DET(spark, sf), ACTIVE(spark, sf), 0.5, in_order)


@query(over(_METRICS, _greedy_sql("-iou, det_idx, gt_idx")))
def det_metrics_global(spark, sf):
    return matching.detection_metrics(_frames(spark, sf, False))


@query(over(_METRICS, _greedy_sql("det_idx, -iou, gt_idx")))
def det_metrics_in_order(spark, sf):
    return matching.detection_metrics(_frames(spark, sf, True))


@query(over("SELECT frame_index, tp, fp, fn FROM c", _greedy_sql("-iou, det_idx, gt_idx")))
def frame_union(spark, sf):
    return matching.frame_scores(_frames(spark, sf, False)).select("frame_index", "tp", "fp", "fn")


@query(over("SELECT frame_index, det_idx FROM dets d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.frame_index = d.frame_index AND m.det_idx = d.det_idx)", _greedy_sql("-iou, det_idx, gt_idx")))
def unmatched_detections(spark, sf):
    d = DET(spark, sf)
    return d.join(matching.greedy_boxes(d, ACTIVE(spark, sf)), ["seq_id", "frame_index", "det_idx"], "left_anti").select("frame_index", "det_idx")


@query(over("SELECT frame_index, det_idx, gt_idx, iou FROM (SELECT *, row_number() OVER (PARTITION BY frame_index, det_idx ORDER BY iou DESC, gt_idx) AS k FROM dp) WHERE k = 1"))
def best_gt_per_det(spark, sf):
    return matching.best_gt(DPAIRS(spark, sf)).drop("seq_id")


def _best(spark, sf) -> DataFrame:
    return matching.optimal_boxes(T(spark, sf), ACTIVE(spark, sf).withColumnRenamed("track_id", "gt_id"), "track_id", "gt_id")


@query(over("SELECT frame_index, track_id, gt_id, iou FROM tp WHERE track_id = gt_id"))
def lap_match(spark, sf):
    """Annotations stand at their tracks' own boxes, so the best total takes each one's own."""
    return _best(spark, sf).drop("seq_id")


@query(over("SELECT g AS total_gt, g AS tp, t - g AS fp, CAST(0 AS BIGINT) AS fn, CAST(0 AS BIGINT) AS id_switches, 1 - (t - g) / g AS mota, g / t AS precision, 1.0::DOUBLE AS recall FROM (SELECT (SELECT count(*) FROM active) AS g, (SELECT count(*) FROM tracks) AS t)"))
def clear_mot(spark, sf):
    return matching.clear_mot(T(spark, sf), ACTIVE(spark, sf), _best(spark, sf)).drop("seq_id")


_OTHERS = "om AS (SELECT frame_index, gt_id, arg_max(track_id, [iou, -track_id]) AS track_id FROM tp WHERE track_id <> gt_id GROUP BY 1, 2), sw AS (SELECT * FROM (SELECT *, lag(track_id) OVER (PARTITION BY gt_id ORDER BY frame_index) AS previous_track FROM om) WHERE previous_track <> track_id)"


def _others(spark, sf) -> DataFrame:
    """Given matches, so that ids switch: of each annotation, the best overlapping track of another person."""
    p = TPAIRS(spark, sf).filter("track_id <> gt_id")
    return p.groupBy("seq_id", "frame_index", "gt_id").agg(F.max_by("track_id", F.struct("iou", -F.col("track_id"))).alias("track_id"))


@query(over("SELECT frame_index, gt_id, previous_track, track_id FROM sw", _OTHERS))
def id_switches(spark, sf):
    return matching.id_switches(_others(spark, sf)).select("frame_index", "gt_id", "previous_track", "track_id")


@query(over("SELECT g AS total_gt, m AS tp, t - m AS fp, g - m AS fn, s AS id_switches, 1 - (g - m + t - m + s) / g AS mota, m / t AS precision, m / g AS recall FROM (SELECT (SELECT count(*) FROM active) AS g, (SELECT count(*) FROM tracks) AS t, (SELECT count(*) FROM om) AS m, (SELECT count(*) FROM sw) AS s)", _OTHERS))
def clear_mot_given(spark, sf):
    """CLEAR-MOT over given matches with misses and switches."""
    return matching.clear_mot(T(spark, sf), ACTIVE(spark, sf), _others(spark, sf)).drop("seq_id")


@query(over("SELECT track_id, gt_id, count(*) AS n_frames FROM tp WHERE iou >= 0.5 GROUP BY 1, 2"))
def id_overlap_counts(spark, sf):
    return matching.overlap_counts(TPAIRS(spark, sf)).drop("seq_id")


@query(over("SELECT g AS idtp, t - g AS idfp, CAST(0 AS BIGINT) AS idfn, 2 * g / (t + g) AS idf1 FROM (SELECT (SELECT count(*) FROM active) AS g, (SELECT count(*) FROM tracks) AS t)"))
def idf1(spark, sf):
    """No track shares more frames with an annotation than its own one, which shares all."""
    return matching.identity_score(matching.overlap_counts(TPAIRS(spark, sf)), T(spark, sf), ACTIVE(spark, sf)).drop("seq_id")


def cameras(spark, sf) -> DataFrame:
    """The detections dealt over eight cameras, so that sequences run side by side."""
    return DET(spark, sf).withColumn("seq_id", F.concat(F.lit("cam-"), F.col("track_id") % 8))


@query()
def tracker(spark, sf):
    d = cameras(spark, sf)
    return tracking.track(d, d.select("seq_id", "frame_index"), Tracker())


# --- audits ---------------------------------------------------------------------------------------


@query(over("SELECT count(*) AS total_compared, count(*) FILTER (i.zone_ids = list_transform(g.zone_ids, lambda z: replace(z, 'Ground_', ''))) AS agree, count(*) FILTER (i.zone_ids = list_transform(g.zone_ids, lambda z: replace(z, 'Ground_', ''))) / count(*) AS agreement_ratio FROM im i JOIN gm g USING (track_id, frame_index)"))
def cross_space_agreement(spark, sf):
    return audit.agreement(MEMBERS(spark, sf), GMEMBERS(spark, sf), mapping={"Zone_Ground_Central": "Zone_Central", "Zone_Ground_Left": "Zone_Left"})


@query(over("SELECT count(*) AS total_compared, count(*) FILTER (i.zone_ids = g.zone_ids) AS agree, count(*) FILTER (i.zone_ids = g.zone_ids) / count(*) AS agreement_ratio FROM im i JOIN gm g USING (track_id, frame_index)"))
def cross_space_agreement_by_id(spark, sf):
    """By the zones' own ids, which differ between the spaces: points outside both."""
    return audit.agreement(MEMBERS(spark, sf), GMEMBERS(spark, sf))


_SPACE = "SELECT '{}' AS space, zone_id, count(*) AS visits, count(DISTINCT track_id) AS visitors, CAST(sum(last_observed_frame - entry_frame) AS BIGINT) / 30.0::DOUBLE AS dwell_seconds FROM {} GROUP BY 2"


@query(over(_SPACE.format("image", "v0") + " UNION ALL " + _SPACE.format("ground", "gv")))
def cross_space_visits(spark, sf):
    return audit.visits_by_space(VISITS(spark, sf), GVISITS(spark, sf), presets.FPS)


def _audited(spark, sf) -> DataFrame:
    points = files.kept(FOOT(spark, sf))
    g = ground.project(points, C09)
    m, gm = zones.memberships(points, presets.ZONES_09), zones.ground_memberships(g, presets.GROUND_09)
    cells, gcells = heatmaps.image_cells(points, presets.CANVAS), heatmaps.ground_cells(g, presets.GRID_09)
    return audit.conservation(points, g, cells, gcells, m, gm, zones.visits(m, presets.DWELL), zones.visits(gm, presets.DWELL))


@query(over("""SELECT name, a = b AS passed, a AS left_value, b AS right_value FROM (
    SELECT 'AC-03: Projection State Conservation' AS name, (SELECT count(*) FROM foot) AS a, (SELECT count(*) FILTER (is_valid) + count(*) FILTER (NOT is_valid) FROM gr) AS b
    UNION ALL SELECT 'AC-04: Image Heatmap Conservation', (SELECT count(*) FROM foot), (SELECT count(status) FROM hc)
    UNION ALL SELECT 'AC-05: Ground Heatmap Conservation', (SELECT count(*) FROM gr), (SELECT count(status) FROM gc)
    UNION ALL SELECT 'AC-06a: Image Zone Conservation', (SELECT count(*) FROM foot), (SELECT count(*) FROM im)
    UNION ALL SELECT 'AC-06b: Ground Zone Conservation', (SELECT count(*) FROM gr), (SELECT count(*) FROM gm)
    UNION ALL SELECT 'AC-07a: Image Dwell Overlap Conservation', (SELECT CAST(sum(observation_count) AS BIGINT) FROM v0), (SELECT CAST(sum(len(zone_ids)) AS BIGINT) FROM im)
    UNION ALL SELECT 'AC-07b: Ground Dwell Overlap Conservation', (SELECT CAST(sum(observation_count) AS BIGINT) FROM gv), (SELECT CAST(sum(len(zone_ids)) AS BIGINT) FROM gm))"""))
def conservation_audit(spark, sf):
    return _audited(spark, sf)


_BROKEN = ["(SELECT count(*) FROM tracks WHERE confidence < 0.1)", "a + s", "s", "a", "(SELECT count(*) FROM im WHERE y > 900) + a + s", "(SELECT count(*) FROM v0 WHERE zone_id = 'Zone_Left')", "(SELECT count(*) FROM hc WHERE status = 'out_of_bounds')"]


@query(over("SELECT name, v = 0 AS passed, v AS violations FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, {v} AS v FROM broken" for n, v in zip(audit.INVARIANTS, _BROKEN, strict=True)) + ")",
    "broken AS (SELECT count(*) FILTER (confidence >= 0.9) AS a, count(*) FILTER (x < 0) AS s FROM foot)"))
def invariants(spark, sf):
    """Over tables with faults put in: lost tracks, repeated and stray points, missing memberships, overfull visits, cells without a status."""
    t = files.kept(T(spark, sf))
    p = tracks.footpoints(t)
    points = p.unionByName(p.filter("confidence >= 0.9")).unionByName(p.filter("x < 0").withColumn("frame_index", F.col("frame_index") + 100_000))
    m = zones.memberships(p, presets.ZONES_09)
    v = zones.visits(m, presets.DWELL).withColumn("observation_count", F.when(F.col("zone_id") == "Zone_Left", F.col("observation_count") + 1000).otherwise(F.col("observation_count")))
    cells = heatmaps.image_cells(p, presets.CANVAS).withColumn("status", F.when(F.col("status") != "out_of_bounds", F.col("status")))
    return audit.invariants(t.withColumn("state", F.when(F.col("confidence") < 0.1, "lost").otherwise(F.col("state"))), points, m.filter("y <= 900"), v, cells)


@query(over("SELECT *, zone_id_ AS zone_id FROM (SELECT count(*) FILTER (zone_id <> 'Zone_Left' AND entry_frame <= 20 OR zone_id = 'Zone_Left' AND entry_frame < 1) AS visit_entry, count(*) FILTER (zone_id = 'Zone_Left') AS visit_order, count(*) FILTER (zone_id = 'Zone_Left') AS visit_count, count(*) FILTER (zone_id = 'Zone_Central') AS zone_id_ FROM v0), (SELECT count(*) FILTER (x > 10) AS ground_track, count(*) FILTER (y > 4) AS ground_frame, count(*) FILTER (is_extrapolated) AS ground_finite FROM gr)").replace("SELECT *, zone_id_ AS zone_id FROM", "SELECT * RENAME (zone_id_ AS zone_id) FROM"))
def constraint_violations(spark, sf):
    """Over rows with faults put in: early entries, visits that end before they begin, nameless zones, bad ids, frames and coordinates."""
    left = F.col("zone_id") == "Zone_Left"
    v = VISITS(spark, sf).withColumns({"last_observed_frame": F.when(left, F.col("entry_frame") - 1).otherwise(F.col("last_observed_frame")), "entry_frame": F.when(left, F.col("entry_frame")).otherwise(F.col("entry_frame") - 20), "zone_id": F.when(F.col("zone_id") != "Zone_Central", F.col("zone_id")).otherwise("")})
    g = GROUND(spark, sf).withColumns({"track_id": F.when(F.col("x") > 10, -1).otherwise(F.col("track_id")), "frame_index": F.when(F.col("y") > 4, 0).otherwise(F.col("frame_index")), "x": F.when(F.col("is_extrapolated"), float("nan")).otherwise(F.col("x"))})
    return audit.violations(v, g)


@query(over("SELECT 'total_gaps' AS path, CAST(n AS DOUBLE) AS value1, CAST(n + 1 AS DOUBLE) AS value2, 'EXACT_MISMATCH' AS difference FROM (SELECT count(*) AS n FROM (SELECT frame_index - lag(frame_index) OVER (PARTITION BY track_id ORDER BY frame_index) AS d FROM foot) WHERE d > 1)"))
def reproducibility_diff(spark, sf):
    """A run against itself, with one count changed and one float within the tolerance."""
    one = tracks.summary(FOOT(spark, sf), presets.FPS)
    two = one.withColumn("total_gaps", F.col("total_gaps") + 1).withColumn("mean_gap_frames", F.col("mean_gap_frames") + 1e-6)
    return audit.reproducibility(audit.unpivot(one), audit.unpivot(two))


@query("SELECT substr(name, 1, 10) || CASE WHEN length(name) < 10 THEN repeat(' ', 10 - length(name)) ELSE '' END || CASE WHEN passed THEN ' PASS ' ELSE ' FAIL ' END || left_value || ' == ' || right_value AS line FROM (" + ORACLES["conservation_audit"] + ")")
def audit_log(spark, sf):
    return audit.audit_log(_audited(spark, sf))


_PARTS = {"trajectories": trajectory_stats, "detection": det_metrics_in_order, "zones": zone_diagnostics, "dwell": dwell_diagnostics, "projection": projection_diagnostics, "heatmap": heatmap_diagnostics}


@query(" UNION ALL ".join(f"SELECT '{k}' AS part, metric, value FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM ({ORACLES[f.__name__]})) ON COLUMNS(*) INTO NAME metric VALUE value)" for k, f in _PARTS.items()))
def report_json(spark, sf):
    """The report's JSON, read back as a number a row."""
    row = audit.report_json(**{k: f(spark, sf) for k, f in _PARTS.items()})
    parts = row.select(F.explode(F.from_json("report", "map<string,map<string,string>>")).alias("part", "numbers"))
    return parts.select("part", F.explode("numbers").alias("metric", "value")).withColumn("value", F.col("value").cast("double"))


# --- streaming ------------------------------------------------------------------------------------------


def _event_points(spark, sf) -> DataFrame:
    """Every event as a point, first come first, as a stream."""
    e = replay.read_files(spark, sf, "events.parquet")
    frame = (F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / float(adapters.FRAME_US)) + 1).cast("int")
    t, f = F.col("track_id"), F.col("frame_index")
    p = e.select(F.lit("events").alias("seq_id"), F.col("user_id").cast("int").alias("track_id"), frame.alias("frame_index"), F.col("event_id").alias("order"))
    return p.withColumn("x", ((t * 131 + f * 17) % 2000) - F.lit(40.0) + (F.col("order") % 10) / F.lit(10.0)).withColumn("y", ((t * 71 + f * 5) % 1150) - F.lit(20.0))


@query(over("SELECT CAST(floor(y / 50) AS INTEGER) AS row, CAST(floor(x / 50) AS INTEGER) AS col, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT ((track_id * 131 + frame_index * 17) % 2000) - 40.0::DOUBLE + (event_id % 10) / 10.0::DOUBLE AS x, ((track_id * 71 + frame_index * 5) % 1150) - 20.0::DOUBLE AS y FROM b) WHERE x >= 0 AND x < 1920 AND y >= 0 AND y < 1080 GROUP BY 1, 2"))
def stream_heatmap(spark, sf):
    return replay.run_to_end(replay.heatmap(_event_points(spark, sf), presets.CANVAS), "complete")


@query(over("SELECT track_id, zone_id, entry_frame, last_observed_frame, observation_count FROM v1"))
def stream_dwell(spark, sf):
    changes = replay.run_to_end(replay.dwell(_event_points(spark, sf), presets.ZONES_09, Dwell(presets.FPS, 1)), "update")
    return replay.latest_visits(changes).drop("seq_id", "closed")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Scan, projection, zone membership, dwell visits, analytics by zone."""
    return zones.zone_analytics(VISITS(spark, sf), presets.ZONES_09, presets.DWELL)
