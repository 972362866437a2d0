"""Ground-plane calibration: a homography by normalised direct linear transform, on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.geometry import finite, in_convex

Pair = tuple[tuple[float, float], tuple[float, float]]


def reject_collinear(points: np.ndarray, least: float = 1e-4) -> None:
    """ValueError if three of the points span a triangle under ``least``."""
    for a, b, c in combinations(points, 3):
        if abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2 < least:
            raise ValueError("three points lie on a line")


def _centred(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points with centroid 0 and mean distance sqrt(2), and the transform that does it."""
    centre = points.mean(0)
    spread = np.linalg.norm(points - centre, axis=1).mean()
    if spread < 1e-9:
        raise ValueError("the points coincide")
    s = np.sqrt(2) / spread
    return (points - centre) * s, np.array([[s, 0, -s * centre[0]], [0, s, -s * centre[1]], [0, 0, 1]])


def estimate(source: Sequence, target: Sequence, check_condition: bool = True) -> np.ndarray:
    """The 3 x 3 matrix that takes source points to target points, scaled so that its last entry is 1."""
    a, b = np.asarray(source, float), np.asarray(target, float)
    if a.shape != b.shape or a.ndim != 2 or a.shape[1] != 2 or len(a) < 4:
        raise ValueError("four pairs of points or more are needed")
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        raise ValueError("points are finite")
    reject_collinear(a)
    reject_collinear(b)
    (p, tp), (q, tq) = _centred(a), _centred(b)
    one, none = np.ones(len(p)), np.zeros((len(p), 3))
    home = np.column_stack([p, one])
    upper = np.hstack([-home, none, q[:, :1] * home])
    lower = np.hstack([none, -home, q[:, 1:] * home])
    _, _, v = np.linalg.svd(np.vstack([upper, lower]))
    h = np.linalg.inv(tq) @ v[-1].reshape(3, 3) @ tp
    h = h / (h[2, 2] if abs(h[2, 2]) > 1e-9 else np.linalg.norm(h))
    if abs(np.linalg.det(h)) < 1e-9 or check_condition and np.linalg.cond(h) > 1e7:
        raise ValueError("the homography is degenerate")
    return h


def apply(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    x = np.column_stack([np.asarray(points, float), np.ones(len(points))]) @ h.T
    if (np.abs(x[:, 2]) <= 1e-9).any():
        raise ValueError("a point lies on the horizon")
    return x[:, :2] / x[:, 2:]


def reprojection_errors(h: np.ndarray, source: Sequence, target: Sequence) -> dict[str, float]:
    """Mean, median, root mean square and largest forward error; mean, root mean square and largest backward one."""
    a, b = np.asarray(source, float), np.asarray(target, float)
    there = np.linalg.norm(apply(h, a) - b, axis=1)
    back = np.linalg.norm(apply(np.linalg.inv(h), b) - a, axis=1)
    rms = lambda e: float(np.sqrt((e * e).mean()))
    return {
        "mean_forward": float(there.mean()), "median_forward": float(np.median(there)), "rmse_forward": rms(there), "max_forward": float(there.max()),
        "mean_backward": float(back.mean()), "rmse_backward": rms(back), "max_backward": float(back.max()),
    }


FRAMES = ("image_pixel", "arbitrary_planar", "metric_ground")


@dataclass(frozen=True)
class Calibration:
    """A homography with the reference points it came from. The polygon of their image points bounds trusted ground."""

    points: tuple[Pair, ...]
    forward: tuple[tuple[float, ...], ...]
    backward: tuple[tuple[float, ...], ...]
    rmse: float
    frame: str = "arbitrary_planar"
    units: str = "units"
    metadata: dict = field(default_factory=dict)

    @staticmethod
    def of(points: Sequence[Pair], frame: str = "arbitrary_planar", units: str = "units", matrix: Sequence | None = None) -> Calibration:
        if frame not in FRAMES or frame == "metric_ground" and units != "meters":
            raise ValueError("metric ground is in meters")
        if len(points) < 4:
            raise ValueError("four reference points or more are needed")
        a, b = [p for p, _ in points], [q for _, q in points]
        h = np.asarray(matrix, float) if matrix is not None else estimate(a, b)
        back = np.linalg.inv(h)
        back = back / back[2, 2] if abs(back[2, 2]) > 1e-9 else back
        rows = lambda m: tuple(tuple(map(float, r)) for r in m)
        return Calibration(tuple(points), rows(h), rows(back), reprojection_errors(h, a, b)["rmse_forward"], frame, units)

    @property
    def region(self) -> list[tuple[float, float]]:
        return [p for p, _ in self.points]

    def sums(self, x: Column, y: Column) -> tuple[Column, Column, Column]:
        """The two numerators and the denominator of an image point's place on the ground."""
        u, v, w = ((h[0] * x + h[1] * y) + h[2] for h in self.forward)
        return u, v, w

    @staticmethod
    def quotients(x: Column, y: Column, u: Column, v: Column, w: Column) -> tuple[Column, ...]:
        """Whether the input is finite, whether the denominator is sound, and the place if so."""
        denominator = finite(w) & (w > 1e-7)
        return finite(x, y), denominator, F.when(denominator, u / w), F.when(denominator, v / w)

    def project(self, x: Column, y: Column, held: tuple[Column, ...] | None = None) -> Column:
        """Struct (x, y, is_valid, is_extrapolated, error_code, frame) of an image point on the ground.

        Tests come in order: the input is finite, the denominator exceeds 1e-7,
        the output is finite. A point that fails is invalid; of the last kind
        alone the coordinates are kept. ``held`` may be columns of ``quotients``.
        """
        sound, denominator, gx, gy = held or self.quotients(x, y, *self.sums(x, y))
        nan = F.lit(float("nan"))
        valid = sound & denominator & finite(gx, gy)
        code = F.when(~sound, "NON_FINITE_INPUT").when(~denominator, "PROJECTIVE_DENOMINATOR_TOO_SMALL").when(~finite(gx, gy), "NON_FINITE_OUTPUT")
        return F.struct(
            F.when(sound & denominator, gx).otherwise(nan).alias("x"), F.when(sound & denominator, gy).otherwise(nan).alias("y"),
            valid.alias("is_valid"), (valid & ~in_convex(x, y, self.region)).alias("is_extrapolated"), code.alias("error_code"), F.lit(self.frame).alias("frame"),
        )

    def to_image(self, x: Column, y: Column) -> Column:
        """Struct (x, y) of a ground point in the image; an error on the horizon and for what is not finite."""
        h = self.backward
        u, v, w = ((h[i][0] * x + h[i][1] * y) + h[i][2] for i in range(3))
        ok = finite(x, y) & (F.abs(w) > 1e-9)
        bad = F.raise_error(F.lit("no image point for this ground point")).cast("double")
        return F.struct(F.when(ok, u / w).otherwise(bad).alias("x"), F.when(ok, v / w).otherwise(bad).alias("y"))
