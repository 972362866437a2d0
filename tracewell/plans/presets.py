"""Scene presets: calibration points, zones and grids of two fixed cameras, and zones for tests of concave shapes."""

from __future__ import annotations

from tracewell.config import Dwell, GroundGrid, ImageGrid, Zone, Zones
from tracewell.functions.homography import Calibration

# Image point to ground point, by preset.
POINTS_09 = (((200.0, 550.0), (0.0, 8.0)), ((1500.0, 550.0), (20.0, 8.0)), ((1750.0, 950.0), (20.0, 0.0)), ((150.0, 950.0), (0.0, 0.0)))
POINTS_02 = (((400.0, 450.0), (0.0, 15.0)), ((1550.0, 450.0), (15.0, 15.0)), ((1750.0, 950.0), (15.0, 0.0)), ((200.0, 950.0), (0.0, 0.0)))
HORIZON = (((200.0, 200.0), (0.0, 100.0)), ((400.0, 200.0), (10.0, 100.0)), ((500.0, 500.0), (10.0, 1.0)), ((100.0, 500.0), (0.0, 1.0)))
# The homography of each preset, so that plans are the same on every machine.
MATRIX_09 = ((0.022535211267605642, 0.002816901408450706, -6.056338028169014), (0.0, -0.029295774647887334, 27.830985915492967), (0.0, 0.0008450704225352128, 1.0))
MATRIX_02 = ((0.018987341772151896, 0.007594936708860745, -11.012658227848094), (0.0, -0.04367088607594935, 41.48734177215188), (0.0, 0.0010126582278481005, 1.0))

FPS = 30.0
CANVAS = ImageGrid(1920, 1080, 50)
DWELL = Dwell(FPS, 0)

CALIBRATION_09 = Calibration.of(POINTS_09, matrix=MATRIX_09)
CALIBRATION_02 = Calibration.of(POINTS_02, matrix=MATRIX_02)
ZONES_09 = Zones.of(Zone.box("Zone_Central", 384.0, 432.0, 1536.0, 918.0), Zone.box("Zone_Left", 96.0, 378.0, 672.0, 972.0))
ZONES_02 = Zones.of(Zone.box("Zone_Concourse", 384.0, 432.0, 1536.0, 918.0), Zone.box("Zone_Right", 1152.0, 378.0, 1824.0, 972.0))
GROUND_09 = Zones.of(Zone.box("Zone_Ground_Central", 3.0, 1.0, 18.0, 7.0, True), Zone.box("Zone_Ground_Left", 0.0, 0.0, 6.0, 8.0, True))
GROUND_02 = Zones.of(Zone.box("Zone_Ground_Concourse", 2.0, 2.0, 13.0, 13.0, True), Zone.box("Zone_Ground_Right", 9.0, 1.0, 14.5, 14.0, True))
GRID_09 = GroundGrid(0.0, 20.0, 0.0, 8.0, 0.5)
GRID_02 = GroundGrid(0.0, 15.0, 0.0, 15.0, 0.5)
#: an L, and a triangle whose sides lie at an angle
SHAPES = Zones.of(
    Zone("Shape_L", ((100.0, 100.0), (700.0, 100.0), (700.0, 500.0), (1400.0, 500.0), (1400.0, 1000.0), (100.0, 1000.0))),
    Zone("Shape_Triangle", ((300.0, 50.0), (1800.0, 400.0), (900.0, 1050.0))),
)
