"""Ground-plane observations and their diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.homography import Calibration

KEYS = ("seq_id", "track_id")


def project(points: DataFrame, calibration: Calibration) -> DataFrame:
    """Each foot point on the ground, with its image coordinates kept as provenance. Nine literals, no UDF.

    The generators of one row a point, of its sums, its quotients and then of
    the rest, keep the optimizer from writing these out again wherever a later
    step reads them: the JVM does not compile a method of over 8,000 bytes.
    """
    g = points.select(*KEYS, "frame_index", F.col("x").alias("source_x"), F.col("y").alias("source_y"))
    x, y, sums, held = F.col("source_x"), F.col("source_y"), "uvw", ("sound", "denominator", "gx", "gy")
    also = lambda names, cols: g.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in zip(names, cols, strict=True)]))))
    g = also(sums, calibration.sums(x, y))
    g = also(held, calibration.quotients(x, y, *map(F.col, sums)))
    g = g.select("*", F.inline(F.array(calibration.project(x, y, tuple(map(F.col, held))))))
    return g.select(*KEYS, "frame_index", "x", "y", "is_valid", "is_extrapolated", "error_code", "frame", "source_x", "source_y")


def accepted(ground: DataFrame, allow_extrapolated: bool = True) -> DataFrame:
    return ground.filter(F.col("is_valid") & (F.lit(allow_extrapolated) | ~F.col("is_extrapolated")))


def quarantined(ground: DataFrame) -> DataFrame:
    return ground.filter("not is_valid").select(*KEYS, "frame_index", "source_x", "source_y", F.coalesce("error_code", F.lit("UNKNOWN")).alias("error_code"))


def trajectories(ground: DataFrame, allow_extrapolated: bool = True) -> DataFrame:
    """One row a track of its accepted points."""
    a = accepted(ground, allow_extrapolated).groupBy(*KEYS)
    return a.agg(F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"), F.count("*").alias("n_points"), F.count_if(F.col("is_extrapolated")).alias("extrapolated_count"))


def error_codes(ground: DataFrame) -> DataFrame:
    bad = ground.filter("not is_valid")
    return bad.groupBy(F.coalesce("error_code", F.lit("UNKNOWN")).alias("error_code")).agg(F.count("*").alias("n_points"))


def diagnostics(ground: DataFrame, allow_extrapolated: bool = True) -> DataFrame:
    ok = F.col("is_valid")
    out = ok & F.col("is_extrapolated")
    takes = ok & (F.lit(allow_extrapolated) | ~F.col("is_extrapolated"))
    return ground.agg(F.count("*").alias("total"), F.count_if(ok & ~F.col("is_extrapolated")).alias("in_roi"), F.count_if(out).alias("extrapolated"), F.count_if(~ok).alias("invalid"), F.count_if(takes).alias("accepted"), F.count_if(~takes).alias("excluded"))
