"""Hashed colours, wireframes and whole frames against plain Python; plans of the assignment; moving frames in runs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from octolith import settings as st
from octolith.config import TreeParams
from octolith.functions import colour
from octolith.operators import cloud, profile, raster, select
from octolith.operators.tree import Tree
from octolith.plans import pipelines, render

CAMERA = st.Camera.orbit((1.0, 1.0, 1.0), 48, 27)


@pytest.fixture(scope="module")
def built(spark):
    r = random.Random(6)
    rows = [(k, r.random(), r.random() ** 2, r.random() * 0.6, r.randrange(1 << 32)) for k in range(600)]
    points = spark.createDataFrame(rows, "seq long, x double, y double, z double, rgba long")
    return pipelines.Adaptive(TreeParams(40, 20, 2)).build(points)


def test_hashed_column_equals_the_function(spark):
    keys = [0, 1, 7, 255, 65_536, 2**31, 2**32 - 1, *random.Random(1).sample(range(2**32), 50)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", colour.hashed(F.col("k")).alias("c"))
    assert all(r.c == colour.key_colour(r.k) for r in df.collect())
    for c in colour.level_colours():
        assert c >> 24 == 255 and all(96 <= c >> s & 255 <= 255 for s in (0, 8, 16))


def project(x, y, z):
    m = CAMERA.matrix
    cx, cy, w = (x * m[k][0] + y * m[k][1] + z * m[k][2] + m[k][3] for k in (0, 1, 3))
    return cx, cy, w


def screen(cx, cy, w):
    return (cx / w * 0.5 + 0.5) * CAMERA.width, (cy / w * 0.5 + 0.5) * CAMERA.height


def put(image, px, py, value):
    if 0 <= px < CAMERA.width and 0 <= py < CAMERA.height and ((px, py) not in image or image[px, py] > value):
        image[px, py] = value


def plain_lines(edges):
    image = {}
    for e in edges:
        a, b = project(e.x0, e.y0, e.z0), project(e.x1, e.y1, e.z1)
        if a[2] < 1e-6 and b[2] < 1e-6:
            continue
        ends = []
        for p in (a, b):
            if p[2] < 1e-6:
                t = (1e-6 - a[2]) / (b[2] - a[2])
                p = tuple(u + t * (v - u) for u, v in zip(a, b))
            ends.append((*screen(*p), 1 / p[2]))
        (x0, y0, i0), (x1, y1, i1) = ends
        dx, dy, low, high, out = x1 - x0, y1 - y0, 0.0, 1.0, False
        for p, q in ((-dx, x0), (dx, CAMERA.width - 1.0 - x0), (-dy, y0), (dy, CAMERA.height - 1.0 - y0)):
            if p == 0:
                out |= q < 0
            elif p < 0:
                low = max(low, q / p)
            else:
                high = min(high, q / p)
        if out or low > high:
            continue
        steps = int(max(abs(dx), abs(dy)) * (high - low)) + 1
        for i in range(steps + 1):
            at = low + (high - low) * i / steps
            put(image, math.trunc(x0 + at * dx), math.trunc(y0 + at * dy), (1 / (i0 + at * (i1 - i0)), colour.key_colour(e.level * 2654435761)))
    return image


def test_wireframe_equals_plain_lines(built):
    edges = select.box_edges(select.frontier(select.visibility(built.tree, built.box, CAMERA, 6.0)))
    got = {(r.px, r.py): (r.depth, r.rgba) for r in raster.wireframe(edges, CAMERA).collect()}
    want = plain_lines(edges.collect())
    assert len(want) > 100 and want.keys() == got.keys()
    assert all(got[k][0] == pytest.approx(v[0]) for k, v in want.items())
    assert sum(got[k][1] == v[1] for k, v in want.items()) >= 0.99 * len(want)  # lines of several levels that share an edge may differ in the last bit of depth


@pytest.mark.parametrize("boxes", [False, True])
def test_frame_equals_plain_frame(built, boxes):
    options = render.Options(6.0, point_size=3, colour="level", show_boxes=boxes)
    got = {(r.px, r.py): r.rgba for r in render.frame(built, CAMERA, options).collect()}
    items = select.frontier(select.visibility(built.tree, built.box, CAMERA, 6.0))
    image = {}
    for s in select.samples(built.tree, items, built.box).collect():
        cx, cy, w = project(s.x, s.y, s.z)
        if w > 0:
            fx, fy = screen(cx, cy, w)
            if -2 < fx < CAMERA.width + 1 and -2 < fy < CAMERA.height + 1:
                for dx in (-1, 0, 1):
                    for dy in (-1, 0, 1):
                        put(image, math.trunc(fx) + dx, math.trunc(fy) + dy, (w, colour.key_colour(s.level * 2654435761)))
    shaded = {}
    for (x, y), (depth, rgba) in image.items():
        near = [max(0.0, math.log2(depth) - math.log2(image[x + i, y + j][0])) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)) if (x + i, y + j) in image]
        shade = math.exp((sum(near) / len(near) if near else 0.0) * -24.0 * 0.4)
        dark = [math.floor((rgba >> s & 255) * shade) for s in (0, 8, 16)]
        shaded[x, y] = (depth, dark[0] | dark[1] << 8 | dark[2] << 16 | 255 << 24)
    if boxes:
        for k, v in plain_lines(select.box_edges(items).collect()).items():
            put(shaded, *k, v)
    assert len(got) == CAMERA.width * CAMERA.height
    same = sum(c == (shaded[k][1] if k in shaded else colour.CLEAR) for k, c in got.items())
    assert len(shaded) > 200 and same >= 0.995 * len(got)


def test_frozen_selection_is_shown_by_the_other_camera(built):
    other = st.Camera.orbit((1.0, 1.0, 1.0), 48, 27, yaw=2.0)
    options = render.Options(6.0, shade=0.0)
    frozen = {(r.px, r.py): r.rgba for r in render.frame(built, CAMERA, options, frozen=other).collect()}
    items = select.frontier(select.visibility(built.tree, built.box, other, 6.0))
    want = raster.resolved(raster.pixels(select.samples(built.tree, items, built.box), CAMERA), CAMERA)
    assert frozen == {(r.px, r.py): r.rgba for r in want.collect()}


@pytest.mark.parametrize("threshold,crowd", [(3, 0), (3, 30), (10_000, 0)])
def test_assignment_in_a_few_lookups(spark, monkeypatch, threshold, crowd):
    """Points with a crowd at one place, so that the tree goes to full depth: at most three joins, whatever the depth, broadcast or not."""
    from octolith.operators import tree as module

    r = random.Random(3)
    rows = [(k, r.random(), r.random(), r.random(), 0) for k in range(200)] + [(200 + k, 0.3, 0.3, 0.3, 0) for k in range(crowd)] + [(900, 0.0, 0.0, 0.0, 0), (901, 1.0, 1.0, 1.0, 0)]
    points = spark.createDataFrame(rows, "seq long, x double, y double, z double, rgba long")
    tree = Tree.adaptive(cloud.keyed(points), TreeParams(threshold, 20, 2)).settle()
    leaves = {(n.level, n.code) for n in tree.leaves().collect()}
    for few in (1_000_000, 0):
        monkeypatch.setattr(module, "BROADCAST_CELLS", few)
        df = tree.assigned()
        assert df._jdf.queryExecution().analyzed().toString().count("Join LeftOuter") <= 3
        found = df.collect()
        assert len(found) == len(rows)
        for p in found:
            assert (p.level, p.leaf) in leaves and p.leaf == p.code >> 3 * (20 - p.level)
    tree.close()


def test_moving_frames_in_runs(spark):
    r = random.Random(2)
    rows = [(r.choice("aab"), k, r.random()) for k in range(500)]
    df = spark.createDataFrame(rows, "scope string, seq long, ms double")
    got = {(x.scope, x.seq): (x.mean, x.most) for x in profile.moving(df, frames=20, run=7).collect()}
    assert len(got) == 500
    for s in "ab":
        own = sorted((q, ms) for t, q, ms in rows if t == s)
        for i, (q, _) in enumerate(own):
            window = [ms for _, ms in own[max(0, i - 19) : i + 1]]
            assert got[s, q] == (pytest.approx(sum(window) / len(window)), max(window))
