"""Zone membership of points and dwell visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import Dwell, Zones
from tracewell.functions.geometry import contains

KEYS = ("seq_id", "track_id")


def zone_ids(x: Column, y: Column, zones: Zones, inclusive: bool = True) -> Column:
    """Sorted ids of the zones that hold a point. The zones unroll into the plan: no join, no shuffle."""
    hits = [F.when(contains(x, y, zones.get(z).vertices, inclusive), F.lit(z)) for z in sorted(zones.ids)]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def memberships(points: DataFrame, zones: Zones, inclusive: bool = True) -> DataFrame:
    return points.withColumn("zone_ids", zone_ids(F.col("x"), F.col("y"), zones, inclusive))


def ground_memberships(ground: DataFrame, zones: Zones, allow_extrapolated: bool = True) -> DataFrame:
    """Memberships on the ground; an invalid point, or an extrapolated one where those are barred, is in no zone."""
    may = F.col("is_valid") & (F.lit(allow_extrapolated) | ~F.col("is_extrapolated"))
    return ground.withColumn("zone_ids", F.when(may, zone_ids(F.col("x"), F.col("y"), zones)).otherwise(F.array().cast("array<string>")))


def primary_zone(ids: Column) -> Column:
    """The zone, if there is exactly one."""
    return F.when(F.size(ids) == 1, F.get(ids, F.lit(0)))


def exits(members: DataFrame) -> DataFrame:
    """Zones that a track was in at its observation before and is not in now."""
    before = F.lag("zone_ids").over(Window.partitionBy(*KEYS).orderBy("frame_index"))
    left = members.withColumn("held", before).withColumn("left", F.array_except("held", "zone_ids"))
    return left.select(*KEYS, "frame_index", F.explode("left").alias("zone_id"))


def visits(members: DataFrame, how: Dwell) -> DataFrame:
    """Dwell visits of each track and zone.

    Two rows in a zone are one visit if no observation of the track lies
    between them and at most max_gap_frames frames are missing: an
    observation outside ends a visit whatever the gap. One shuffle by track
    serves the windows and the sums.
    """
    order = Window.partitionBy(*KEYS).orderBy("frame_index")
    # a visit goes on where the row before has the zone too and is near enough
    rows = members.select(*KEYS, "frame_index", "zone_ids", F.lag("zone_ids").over(order).alias("held"), F.lag("frame_index").over(order).alias("before"))
    near = F.col("frame_index") - F.col("before") <= how.max_gap_frames + 1
    inside = rows.select(*KEYS, "frame_index", F.explode("zone_ids").alias("zone_id"), F.when(near, F.col("held")).alias("held"))
    starts = (~F.coalesce(F.array_contains("held", F.col("zone_id")), F.lit(False))).cast("int")
    number = F.sum(starts).over(Window.partitionBy(*KEYS, "zone_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0))
    v = inside.withColumn("visit", number).groupBy(*KEYS, "zone_id", "visit").agg(F.min("frame_index").alias("entry_frame"), F.max("frame_index").alias("last_observed_frame"), F.count("*").alias("observation_count"))
    rate = F.lit(float(how.fps))
    return v.select(
        *KEYS, "zone_id", "entry_frame", "last_observed_frame", ((F.col("entry_frame") - 1) / rate).alias("entry_timestamp"), ((F.col("last_observed_frame") - 1) / rate).alias("exit_timestamp"),
        ((F.col("last_observed_frame") - F.col("entry_frame")) / rate).alias("duration_seconds"), "observation_count",
    )


def zone_analytics(found: DataFrame, zones: Zones, how: Dwell) -> DataFrame:
    """One row a configured zone; zeros for one without visits. Frames are summed whole, then divided."""
    span = F.col("last_observed_frame") - F.col("entry_frame")
    a = found.groupBy("zone_id").agg(F.count("*").alias("n"), F.count_distinct("seq_id", "track_id").alias("v"), F.sum(span).alias("s"), F.max(span).alias("m"), F.sum("observation_count").alias("o"))
    spark = found.sparkSession
    wanted = spark.createDataFrame([(z,) for z in zones.ids], "zone_id string")
    rate, z = F.lit(float(how.fps)), F.lit(0)
    return wanted.join(a, "zone_id", "left").select(
        "zone_id", F.coalesce("n", z).alias("total_visits"), F.coalesce("v", z).alias("unique_visitors"), (F.coalesce("s", z) / rate).alias("total_dwell_time"),
        F.coalesce(F.col("s") / rate / F.col("n"), F.lit(0.0)).alias("average_dwell_time"), (F.coalesce("m", z) / rate).alias("max_dwell_time"), F.coalesce("o", z).alias("total_observations"),
    )


def person_summary(found: DataFrame, how: Dwell) -> DataFrame:
    """One row a track: its visits in order, its dwell and the zones it was in."""
    visit = F.struct("entry_frame", "zone_id", "last_observed_frame", "observation_count")
    span = F.sum(F.col("last_observed_frame") - F.col("entry_frame"))
    return found.groupBy(*KEYS).agg(F.array_sort(F.collect_list(visit)).alias("visits"), (span / F.lit(float(how.fps))).alias("total_dwell_time"), F.array_sort(F.collect_set("zone_id")).alias("zones_visited"))


def active_visits(found: DataFrame, frames: DataFrame) -> DataFrame:
    """Visits under way at each (seq_id, frame_index): entries so far less exits before, summed along the frames.

    Each visit is two events, so nothing grows with a visit's length.
    """
    ins = found.groupBy("seq_id", F.col("entry_frame").alias("frame_index")).agg(F.count("*").alias("d"))
    outs = found.groupBy("seq_id", (F.col("last_observed_frame") + 1).alias("frame_index")).agg((-F.count("*")).alias("d"))
    asked = frames.select("seq_id", "frame_index", F.lit(0).cast("long").alias("d"), F.lit(True).alias("asked"))
    flow = ins.union(outs).withColumn("asked", F.lit(False)).unionByName(asked)
    flow = flow.groupBy("seq_id", "frame_index").agg(F.sum("d").alias("d"), F.max("asked").alias("asked"))
    total = F.sum("d").over(Window.partitionBy("seq_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0))
    return flow.withColumn("active_visits", total).filter("asked").select("seq_id", "frame_index", "active_visits")
