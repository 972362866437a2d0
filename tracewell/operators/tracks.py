"""Foot points, trajectories, gaps and segments of tracked boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.geometry import finite

KEYS = ("seq_id", "track_id")


def corners(df: DataFrame) -> DataFrame:
    """Adds x1, y1, x2, y2 to rows with bb_left, bb_top, bb_width, bb_height."""
    return df.withColumns({"x1": F.col("bb_left"), "y1": F.col("bb_top"), "x2": F.col("bb_left") + F.col("bb_width"), "y2": F.col("bb_top") + F.col("bb_height")})


def footpoint_status(df_width: Column, df_height: Column, *coords: Column) -> Column:
    """Null if a box gives a foot point, else why not; what is not finite comes first."""
    return F.when(~finite(*coords, df_width, df_height), "NON_FINITE").when(df_width <= 0, "WIDTH").when(df_height <= 0, "HEIGHT")


def bottom_center(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """The middle of a box's lower edge, not clipped."""
    return (x1 + x2) / 2, y2


def footpoints(tracks: DataFrame, mode: str = "quarantine", point: Callable[[Column, Column, Column, Column], tuple[Column, Column]] = bottom_center) -> DataFrame:
    """Where each box stands, by ``point``, any function from a box's corners to a point.

    mode 'strict' raises on the first bad box; 'quarantine' drops bad boxes,
    which ``bad_boxes`` lists. There a generator of one row a box keeps the
    optimizer from writing points out again in every later expression.
    """
    box = corners(tracks)
    status = footpoint_status(F.col("bb_width"), F.col("bb_height"), F.col("bb_left"), F.col("bb_top"))
    x, y = point(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    if mode == "strict":
        fail = F.raise_error(F.concat(F.lit("a box gives no foot point: "), status)).cast("double")
        return box.select("seq_id", "track_id", "frame_index", F.when(status.isNull(), x).otherwise(fail).alias("x"), y.alias("y"), "confidence")
    found = F.inline(F.array(F.struct(x.alias("x"), y.alias("y"), status.alias("why"))))
    return box.select("seq_id", "track_id", "frame_index", found, "confidence").filter("why is null").drop("why")


def bad_boxes(tracks: DataFrame) -> DataFrame:
    status = footpoint_status(F.col("bb_width"), F.col("bb_height"), F.col("bb_left"), F.col("bb_top"))
    return tracks.withColumn("status", status).filter("status is not null")


def timestamp(frame: Column, fps: float) -> Column:
    """Seconds since the first frame."""
    if fps <= 0:
        raise ValueError("frame rate is positive")
    return (frame - 1) / F.lit(float(fps))


def trajectories(points: DataFrame, mode: str = "strict") -> DataFrame:
    """One row a track: its points in frame order.

    A track has one point a frame. mode 'strict' raises on a track that has
    more; 'quarantine' leaves such tracks out, which ``duplicates`` lists.
    """
    row = F.struct("frame_index", "x", "y", "confidence")
    t = points.groupBy(*KEYS).agg(F.array_sort(F.collect_list(row)).alias("points"))
    twice = F.size("points") > F.size(F.array_distinct(F.col("points.frame_index")))
    if mode == "quarantine":
        return t.filter(~twice)
    fail = F.raise_error(F.concat(F.lit("a track has two points in a frame: "), F.col("track_id").cast("string"))).cast(t.schema["points"].dataType)
    return t.withColumn("points", F.when(twice, fail).otherwise(F.col("points")))


def trajectory(points: DataFrame, seq_id: str, track_id: int) -> DataFrame:
    """The one trajectory of a track; KeyError for a track without points."""
    own = points.filter((F.col("seq_id") == seq_id) & (F.col("track_id") == track_id))
    if not own.take(1):
        raise KeyError(track_id)
    return trajectories(own)


def bounds(points: DataFrame) -> DataFrame:
    """First and last frame, count and gaps of each track; one shuffle. Repeated frames neither make nor hide a gap."""
    gap = F.max(F.coalesce(F.col("frame_index") - F.col("previous_frame") > 1, F.lit(False)))
    return steps(points).groupBy(*KEYS).agg(F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"), F.count("*").alias("n_points"), gap.alias("has_gaps"))


def duplicates(points: DataFrame) -> DataFrame:
    """Keys that more than one row has."""
    return points.groupBy(*KEYS, "frame_index").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def steps(points: DataFrame) -> DataFrame:
    """Each row with the frame of the track's row before it."""
    return points.withColumn("previous_frame", F.lag("frame_index").over(Window.partitionBy(*KEYS).orderBy("frame_index")))


def gaps(points: DataFrame) -> DataFrame:
    """Frames missing between neighbours of a track, where there are any."""
    g = steps(points).withColumn("gap_frames", F.col("frame_index") - F.col("previous_frame") - 1)
    return g.filter("gap_frames > 0").select(*KEYS, "previous_frame", "frame_index", "gap_frames")


def summary(points: DataFrame, fps: float) -> DataFrame:
    """One row of totals, gap and life-span statistics, and coverage; zeros without points."""
    rate = float(fps) if fps > 0 else 30.0
    per = steps(points).withColumn("gap", F.col("frame_index") - F.col("previous_frame") - 1)
    per = per.groupBy(*KEYS).agg(F.count("*").alias("n"), (F.max("frame_index") - F.min("frame_index") + 1).alias("life"), F.count_if(F.col("gap") > 0).alias("n_gaps"))
    lives = per.agg(
        F.count("*").alias("total_trajectories"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_observations"), F.count_if(F.col("n_gaps") > 0).alias("trajectories_with_gaps"),
        F.min("life").alias("lo"), F.max("life").alias("hi"), F.sum("life").alias("all"), F.median("life").alias("mid"),
    )
    g = gaps(points).agg(F.count("*").alias("total_gaps"), F.min("gap_frames").alias("g_lo"), F.max("gap_frames").alias("g_hi"), F.sum("gap_frames").alias("g_all"), F.median("gap_frames").alias("g_mid"))
    zero, n = F.lit(0.0), F.col("total_trajectories")
    some = lambda c: F.coalesce(c, zero)
    return lives.join(F.broadcast(g)).select(  # two rows of one line each
        "total_trajectories", "total_observations", some(F.try_divide("total_observations", n)).alias("mean_observations_per_track"), "trajectories_with_gaps", "total_gaps",
        F.coalesce("g_lo", F.lit(0)).alias("min_gap_frames"), F.coalesce("g_hi", F.lit(0)).alias("max_gap_frames"), some(F.try_divide("g_all", "total_gaps")).alias("mean_gap_frames"), some(F.col("g_mid")).alias("median_gap_frames"),
        F.coalesce("lo", F.lit(0)).alias("min_lifespan_frames"), F.coalesce("hi", F.lit(0)).alias("max_lifespan_frames"), some(F.try_divide("all", n)).alias("mean_lifespan_frames"), some(F.col("mid")).alias("median_lifespan_frames"),
        some(F.col("lo") / rate).alias("min_lifespan_seconds"), some(F.col("hi") / rate).alias("max_lifespan_seconds"), some(F.try_divide("all", n) / rate).alias("mean_lifespan_seconds"), some(F.col("mid") / rate).alias("median_lifespan_seconds"),
        F.when(n == 0, 0.0).otherwise(F.coalesce(F.try_divide("total_observations", "all"), F.lit(1.0))).alias("frame_coverage_ratio"),
    )


def point_at(points: DataFrame, frames: DataFrame) -> DataFrame:
    """Exact lookup of (seq_id, track_id, frame_index); null where the track has no point, never interpolated."""
    return frames.join(points.select(*KEYS, "frame_index", "x", "y"), [*KEYS, "frame_index"], "left")


def segments(points: DataFrame, gap_threshold: int = 1, upto: int | None = None, window: int | None = None) -> DataFrame:
    """Lines between neighbouring points at most gap_threshold frames apart, within a trailing window of frames."""
    if upto is not None:
        points = points.filter(F.col("frame_index") <= upto)
        if window is not None:
            points = points.filter(F.col("frame_index") > upto - window)
    w = Window.partitionBy(*KEYS).orderBy("frame_index")
    lines = points.select(*KEYS, "frame_index", "x", "y", F.lead("frame_index").over(w).alias("next_frame"), F.lead("x").over(w).alias("next_x"), F.lead("y").over(w).alias("next_y"))
    return lines.filter(F.col("next_frame") - F.col("frame_index") <= gap_threshold)
