"""Parameters that the registered queries and their SQL share: full-size defaults scaled to small tables."""

from __future__ import annotations

from octolith.config import Camera, TreeParams

TREES = {"events": TreeParams(200, 20, 3), "embeddings": TreeParams(50, 20, 3), "lineitem": TreeParams(2000, 20, 3)}
DEPTH = 4
BATCH = 1000
SLOTS = 5
PATH_DEPTH = 6
#: A plane through fewer points says nothing of a surface.
LEAST_SHAPE_POINTS = 20
PIXELS = 12.0
IMAGE = (64, 36)
#: A fixed box near that of the events, so that the camera does not depend on the table.
BOX = (1000.0, 500.0, 800.0)
CAMERA = Camera.orbit(BOX, *IMAGE)
SHAPE_FLOOR = 1e-12
CLOSE_MARGIN = 3
QUEUE_POINTS = 5000
DEEPEN = (0.05, 100)
COLLAPSE = 0.2
ADMISSION = [("ring", n, b, False) for n, b in ((36_200_706, 9_000_000_000), (350_360_028, 6_000_000_000), (350_360_028, 7_050_000_000), (350_360_028, 7_070_000_000), (350_360_028, 11_000_000_000), (1_000, 500_000_000), (1_000_000, 1_200_000_000))] + [("resident", n, b, True) for n, b in ((36_200_706, 9_000_000_000), (60_000_000, 20_000_000_000))]
OCTANT_MASK = 0b10010110
