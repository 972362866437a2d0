"""Views of the events table as observations, tracks, detections and ground truth of one camera.

The columns follow from event ids and times by rule, so that any engine gets the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAME_US = 21_600_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, track_id, frame_index, event_id, event_type, x, y: the first event of each track and frame."""
    # stamps carry no zone: the difference from a stamp without one is the same in every session
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    frame = (F.floor(micros / float(FRAME_US)) + 1).cast("int")
    b = events(spark, sf_dir).select("event_id", F.col("user_id").cast("int").alias("track_id"), "event_type", frame.alias("frame_index"))
    first = b.groupBy("track_id", "frame_index").agg(F.min(F.struct("event_id", "event_type")).alias("e"))
    t, f, e = F.col("track_id"), F.col("frame_index"), F.col("e.event_id")
    x = ((t * 131 + f * 17) % 2000) - F.lit(40.0) + (e % 10) / F.lit(10.0)
    y = ((t * 71 + f * 5) % 1150) - F.lit(20.0)
    return first.select(F.lit("events").alias("seq_id"), "track_id", "frame_index", e.alias("event_id"), F.col("e.event_type").alias("event_type"), x.alias("x"), y.alias("y"))


def tracks(obs: DataFrame) -> DataFrame:
    """Boxes whose foot point is the observation."""
    w = (40 + 4 * (F.col("event_id") % 5)).cast("double")
    return obs.select(
        "seq_id", "track_id", "frame_index", "event_id", "event_type",
        (F.col("x") - w / 2).alias("bb_left"), (F.col("y") - 2 * w).alias("bb_top"), w.alias("bb_width"), (2 * w).alias("bb_height"),
        (((F.col("event_id") * 37) % 100) / F.lit(100.0)).alias("confidence"), F.lit("confirmed").alias("state"),
    )


def detections(track_rows: DataFrame) -> DataFrame:
    """Boxes shifted against the tracks; det_idx counts those of a frame."""
    shift = (((F.col("event_id") % 7) - 3) * 8).cast("double")
    order = F.row_number().over(Window.partitionBy("seq_id", "frame_index").orderBy("event_id"))
    return track_rows.select("seq_id", "frame_index", order.alias("det_idx"), "event_id", "track_id", (F.col("bb_left") + shift).alias("bb_left"), (F.col("bb_top") + shift).alias("bb_top"), "bb_width", "bb_height", "confidence", F.lit("person").alias("class_name"))


def ground_truth(track_rows: DataFrame) -> DataFrame:
    """Annotations at the tracks' own boxes; gt_idx counts those of a frame."""
    order = F.row_number().over(Window.partitionBy("seq_id", "frame_index").orderBy("event_id"))
    return track_rows.select(
        "seq_id", F.col("frame_index").alias("frame"), "track_id", order.alias("gt_idx"), "bb_left", "bb_top", "bb_width", "bb_height",
        F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(1.0).alias("conf"), F.when(F.col("event_type") == "error", 7).otherwise(1).alias("class_id"),
        ((F.col("event_id") % 100) / F.lit(100.0)).alias("visibility"),
    )
