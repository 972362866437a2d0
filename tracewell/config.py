"""Settings of the operators, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from tracewell.functions.geometry import Point, validated


@dataclass(frozen=True)
class ImageGrid:
    """Cells of a canvas: squares of ``cell`` pixels, or an explicit grid, or one cell a pixel."""

    width: int
    height: int
    cell: int | None = None
    columns: int | None = None
    rows: int | None = None

    def __post_init__(self) -> None:
        given = [self.width, self.height, *(v for v in (self.cell, self.columns, self.rows) if v is not None)]
        if any(v <= 0 for v in given):
            raise ValueError("sizes are positive")

    @property
    def shape(self) -> tuple[int, int]:
        """(rows, columns)"""
        if self.cell is not None:
            return math.ceil(self.height / self.cell), math.ceil(self.width / self.cell)
        return self.rows or self.height, self.columns or self.width


@dataclass(frozen=True)
class GroundGrid:
    """Square cells of a closed box on the ground."""

    min_x: float
    max_x: float
    min_y: float
    max_y: float
    cell: float
    allow_extrapolated: bool = True

    def __post_init__(self) -> None:
        if not all(map(math.isfinite, (self.min_x, self.max_x, self.min_y, self.max_y, self.cell))):
            raise ValueError("bounds are finite")
        if self.max_x <= self.min_x or self.max_y <= self.min_y or self.cell <= 0:
            raise ValueError("bounds ascend and cells have a size")

    @property
    def shape(self) -> tuple[int, int]:
        """(rows, columns)"""
        return math.ceil((self.max_y - self.min_y) / self.cell), math.ceil((self.max_x - self.min_x) / self.cell)


@dataclass(frozen=True)
class Dwell:
    fps: float
    max_gap_frames: int = 0

    def __post_init__(self) -> None:
        if not math.isfinite(self.fps) or self.fps <= 0 or self.max_gap_frames < 0:
            raise ValueError("frame rate is positive, the gap is not negative")


@dataclass(frozen=True)
class Tracker:
    high: float = 0.5
    low: float = 0.1
    match: float = 0.5
    min_hits: int = 2
    max_lost_frames: int = 30


@dataclass(frozen=True)
class Zone:
    """A named polygon. ``strict`` also rejects ids of white space, as ground zones do."""

    zone_id: str
    vertices: tuple[Point, ...]
    name: str | None = None
    strict: bool = False

    def __post_init__(self) -> None:
        if not self.zone_id or self.strict and not self.zone_id.strip():
            raise ValueError("a zone has an id")
        object.__setattr__(self, "vertices", tuple(validated(self.vertices)))

    @staticmethod
    def box(zone_id: str, x1: float, y1: float, x2: float, y2: float, strict: bool = False) -> Zone:
        return Zone(zone_id, ((x1, y1), (x2, y1), (x2, y2), (x1, y2)), None, strict)


@dataclass
class Zones:
    """A registry of zones, in the order of registration."""

    held: dict[str, Zone] = field(default_factory=dict)

    @staticmethod
    def of(*zones: Zone) -> Zones:
        made = Zones()
        for z in zones:
            made.add(z)
        return made

    def add(self, zone: Zone) -> None:
        if zone.zone_id in self.held:
            raise ValueError(f"zone {zone.zone_id} is registered")
        self.held[zone.zone_id] = zone

    def get(self, zone_id: str) -> Zone:
        return self.held[zone_id]

    def remove(self, zone_id: str) -> None:
        self.held.pop(zone_id, None)

    def clear(self) -> None:
        self.held.clear()

    @property
    def ids(self) -> list[str]:
        return list(self.held)
