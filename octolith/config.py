"""Parameters as frozen values, with the defaults of full-size clouds."""

from __future__ import annotations

import math
from dataclasses import dataclass

MAX_DEPTH = 20
BATCH_POINTS = 1_000_000
RING_SLOTS = 50
CHUNK_POINTS = 1_000
SLICE_POINTS = 65_536
NODE_CAPACITY = 200_000
DRAW_CAPACITY = 131_072


@dataclass(frozen=True)
class TreeParams:
    """A node splits if it holds more than ``threshold`` points and lies above ``max_depth``; its sample grid has ``2**grid_bits`` cells a side."""

    threshold: int = 50_000
    max_depth: int = MAX_DEPTH
    grid_bits: int = 7


Matrix = tuple[tuple[float, ...], ...]


def _multiply(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


@dataclass(frozen=True)
class Camera:
    """A view-projection matrix with the size of the image."""

    matrix: Matrix
    width: int
    height: int

    @classmethod
    def orbit(cls, size: tuple[float, float, float], width: int = 1600, height: int = 900, yaw: float = 0.35, pitch: float = -0.6, fovy: float = 60.0, zoom: float = 1.1) -> Camera:
        """Looks at the centre of a box from the origin to ``size``, from as far as frames it."""
        diagonal = math.sqrt(sum(s * s for s in size))
        f = math.tan(math.radians(fovy) / 2)
        radius = diagonal / 2 / f * zoom
        centre = [s / 2 for s in size]
        forward = (math.cos(pitch) * math.sin(yaw), math.cos(pitch) * math.cos(yaw), math.sin(pitch))
        eye = [c - radius * d for c, d in zip(centre, forward)]
        right = (math.cos(yaw), -math.sin(yaw), 0.0)
        up = tuple(right[(k + 1) % 3] * forward[(k + 2) % 3] - right[(k + 2) % 3] * forward[(k + 1) % 3] for k in range(3))
        back = tuple(-d for d in forward)
        view = tuple((*axis, -sum(a * e for a, e in zip(axis, eye))) for axis in (right, up, back)) + ((0.0, 0.0, 0.0, 1.0),)
        extent = max(size)
        near, far = extent * 1e-4, extent * 100
        project = ((height / width / f, 0.0, 0.0, 0.0), (0.0, 1 / f, 0.0, 0.0), (0.0, 0.0, -(far + near) / (far - near), -2 * far * near / (far - near)), (0.0, 0.0, -1.0, 0.0))
        return cls(_multiply(project, view), width, height)

    def planes(self) -> list[tuple[float, float, float, float]]:
        """The six planes of the frustum (normal and offset, inside positive), of unit length."""
        m, out = self.matrix, []
        for row in range(3):
            for sign in (1, -1):
                p = [m[3][k] + sign * m[row][k] for k in range(4)]
                length = math.sqrt(p[0] ** 2 + p[1] ** 2 + p[2] ** 2)
                out.append(tuple(v / length for v in p))
        return out
