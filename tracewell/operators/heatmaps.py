"""Sparse density grids in image and ground space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.config import GroundGrid, ImageGrid
from tracewell.functions.geometry import finite


def image_status(x: Column, y: Column, grid: ImageGrid) -> Column:
    """invalid, out_of_bounds or accumulated; the canvas is half open and nothing is clamped."""
    inside = (x >= 0) & (x < grid.width) & (y >= 0) & (y < grid.height)
    return F.when(~finite(x, y), "invalid").when(~inside, "out_of_bounds").otherwise("accumulated")


def image_cells(points: DataFrame, grid: ImageGrid) -> DataFrame:
    """Adds status, and row and col of the accumulated points."""
    x, y = F.col("x"), F.col("y")
    rows, cols = grid.shape
    if grid.cell is not None:
        row, col = F.floor(y / grid.cell), F.floor(x / grid.cell)
    else:
        row, col = F.least(F.floor(y * rows / grid.height), F.lit(rows - 1)), F.least(F.floor(x * cols / grid.width), F.lit(cols - 1))
    tagged = points.withColumn("status", image_status(x, y, grid))
    put = F.col("status") == "accumulated"
    return tagged.withColumns({"row": F.when(put, row).cast("int"), "col": F.when(put, col).cast("int")})


def ground_status(grid: GroundGrid) -> Column:
    """The order of tests: validity, finiteness, extrapolation, the closed box."""
    x, y = F.col("x"), F.col("y")
    inside = x.between(grid.min_x, grid.max_x) & y.between(grid.min_y, grid.max_y)
    barred = F.lit(not grid.allow_extrapolated) & F.col("is_extrapolated")
    return F.when(~F.col("is_valid") | ~finite(x, y), "invalid").when(barred, "extrapolated_rejected").when(~inside, "out_of_bounds").otherwise("accumulated")


def _bin(v: Column, low: float, high: float, cell: float, n: int) -> Column:
    """The cell of a value; the upper bound, up to a relative and absolute 1e-9, is in the last one."""
    at_top = F.abs(v - high) <= F.greatest(1e-9 * F.greatest(F.abs(v), F.lit(abs(high))), F.lit(1e-9))
    return F.when(at_top, n - 1).otherwise(F.least(F.greatest(F.floor((v - low) / cell), F.lit(0)), F.lit(n - 1)))


def ground_cells(ground: DataFrame, grid: GroundGrid) -> DataFrame:
    rows, cols = grid.shape
    tagged = ground.withColumn("status", ground_status(grid))
    put = F.col("status") == "accumulated"
    row, col = _bin(F.col("y"), grid.min_y, grid.max_y, grid.cell, rows), _bin(F.col("x"), grid.min_x, grid.max_x, grid.cell, cols)
    return tagged.withColumns({"row": F.when(put, row).cast("int"), "col": F.when(put, col).cast("int")})


def accumulate(cells: DataFrame, weight: Column | None = None) -> DataFrame:
    """(row, col, weight): sums of the accumulated points, with partial sums before the shuffle."""
    w = weight if weight is not None else F.lit(1.0)
    return cells.filter("status = 'accumulated'").groupBy("row", "col").agg(F.sum(w).alias("weight"))


def status_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("status").agg(F.count("*").alias("n_points"))


def normalized(grid: DataFrame) -> DataFrame:
    """Weights over the largest one. The peak is one row; the grid is bounded by its cells."""
    peak = grid.agg(F.max("weight").alias("peak"))
    return grid.join(F.broadcast(peak)).select("row", "col", F.when(F.col("peak") > 0, F.col("weight") / F.col("peak")).otherwise(0.0).alias("normalized"))


def diagnostics(cells: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """One row: accumulated points, the other states, occupied cells, their share of the grid, the peak."""
    total = shape[0] * shape[1]
    states = cells.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("accumulated", "out_of_bounds", "invalid")])
    grid = accumulate(cells).agg(F.count_if(F.col("weight") != 0).alias("occupied_cells"), F.coalesce(F.max("weight"), F.lit(0.0)).alias("max_cell"))
    return states.join(F.broadcast(grid)).withColumn("occupancy_ratio", F.col("occupied_cells") / F.lit(float(total)))
