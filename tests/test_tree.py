"""Golden counts, and the tree's rules on hand-made clouds."""

import random

import pytest
from pyspark.sql import functions as F

from octolith import settings
from octolith.config import TreeParams
from octolith.operators import accum, cloud, select, voxels
from octolith.operators.tree import Tree
from octolith.sources import views

#: view, scale, points, inner nodes, nonempty leaves, most points in a leaf, depth, voxels of inner nodes
GOLDEN = [
    ("events", "0.001", 1000, 7, 20, 122, 3, 304),
    ("embeddings", "0.001", 500, 7, 43, 47, 3, 560),
    ("lineitem", "0.001", 6000, 1, 4, 1648, 1, 256),
    ("events", "0.01", 10000, 23, 150, 136, 4, 6528),
    ("lineitem", "0.01", 60000, 19, 130, 1987, 3, 4346),
]


@pytest.mark.parametrize("view,sf,points,inner,nonempty,most,depth,n_voxels", GOLDEN)
def test_golden_counts(spark, view, sf, points, inner, nonempty, most, depth, n_voxels):
    p = getattr(views, view)(spark, f"/root/testdata/sf{sf}")
    tree = Tree.adaptive(cloud.keyed(p), settings.TREES[view]).settle()
    s = tree.stats().first()
    assert (s["points"], s["inner_nodes"], s["nodes"], s["leaves"]) == (points, inner, 8 * inner + 1, 7 * inner + 1)
    assert (s["nonempty_leaves"], s["max_points_per_leaf"], s["depth"]) == (nonempty, most, depth)
    assert voxels.stats(tree).first()["voxels"] == n_voxels


def _cloud(spark, rows):
    return spark.createDataFrame([(k, float(x), float(y), float(z), 0xFF000000 + k) for k, (x, y, z) in enumerate(rows)], "seq long, x double, y double, z double, rgba long")


def _brute(rows, threshold, max_depth):
    """The tree by descent: the points of each leaf."""
    low = [min(r[k] for r in rows) for k in range(3)]
    size = max(max(r[k] for r in rows) - low[k] for k in range(3)) or 1.0
    keys = [tuple(int((r[k] - low[k]) / size * 2**20) % 2**20 for k in range(3)) for r in rows]
    leaves, inner = {}, set()

    def descend(level, code, members):
        if len(members) <= threshold or level == max_depth:
            leaves[level, code] = len(members)
            return
        inner.add((level, code))
        parts = {o: [] for o in range(8)}
        for m in members:
            bits = [m[k] >> (19 - level) & 1 for k in range(3)]
            parts[bits[0] * 4 + bits[1] * 2 + bits[2]].append(m)
        for o, p in parts.items():
            descend(level + 1, code * 8 + o, p)

    descend(0, 0, keys)
    return leaves, inner


@pytest.mark.parametrize("seed,threshold,max_depth", [(1, 5, 20), (2, 1, 20), (3, 20, 3), (4, 0, 4)])
def test_closed_form_equals_descent(spark, seed, threshold, max_depth):
    r = random.Random(seed)
    rows = [(r.gauss(0, 1) ** 3, r.random(), r.choice((0, 0.25, r.random()))) for _ in range(150)]
    leaves, inner = _brute(rows, threshold, max_depth)
    tree = Tree.adaptive(cloud.keyed(_cloud(spark, rows)), TreeParams(threshold, max_depth, 2)).settle()
    assert {(x["level"], x["code"]) for x in tree.inner.collect()} == inner
    assert {(x["level"], x["code"]): x["n"] for x in tree.leaves().collect()} == leaves
    counted = {(x["level"], x["leaf"]): x["count"] for x in tree.assigned().groupBy("level", "leaf").count().collect()}
    assert counted == {k: n for k, n in leaves.items() if n}


def test_equal_points_end_at_full_depth(spark):
    tree = Tree.adaptive(cloud.keyed(_cloud(spark, [(3, 3, 3)] * 6)), TreeParams(5, 20, 2)).settle()
    s = tree.stats().first()
    assert (s["inner_nodes"], s["depth"], s["points"], s["max_points_per_leaf"]) == (20, 20, 6, 6)


@pytest.mark.parametrize("n,inner", [(5, 0), (6, 1)])
def test_threshold_is_strict(spark, n, inner):
    rows = [(k % 2, (k >> 1) % 2, (k >> 2) % 2 + k / 100) for k in range(n)]
    assert Tree.adaptive(cloud.keyed(_cloud(spark, rows)), TreeParams(5)).stats().first()["inner_nodes"] == inner


def test_far_face_wraps_in_keys_and_is_held_in_statistics(spark):
    df = cloud.morton_codes(_cloud(spark, [(0, 0, 0), (1, 0, 0)])).orderBy("seq").collect()
    assert df[1]["code"] == 0
    assert df[1]["code_clamped"] == sum(1 << (3 * k + 2) for k in range(20))


def test_order_changes_first_colours_only(spark):
    r = random.Random(9)
    rows = [(r.random(), r.random(), r.random()) for _ in range(60)]
    out = []
    for order in (rows, rows[::-1]):
        tree = Tree.adaptive(cloud.keyed(_cloud(spark, order)), TreeParams(5, 20, 1)).settle()
        grid = {(x["level"], x["node"], x["ix"], x["iy"], x["iz"]): (x["rgba"], x["n"]) for x in voxels.cells(tree).collect()}
        out.append(grid)
    assert out[0].keys() == out[1].keys()
    assert all(out[0][k][1] == out[1][k][1] for k in out[0])
    assert any(out[0][k][0] != out[1][k][0] for k in out[0])


def test_grid_below_full_depth_agrees(spark):
    r = random.Random(5)
    rows = [(r.random(), r.random(), r.random()) for _ in range(80)]
    keyed = cloud.keyed(_cloud(spark, rows))
    fine, coarse = (Tree.adaptive(keyed, TreeParams(20, 20, bits)).settle() for bits in (20, 3))
    assert voxels.counts(fine).agg(F.sum("num_voxels")).first()[0] == sum(x["n"] for x in fine.inner.join(fine.cells, ["level", "code"]).collect())
    assert voxels.stats(coarse).first()["voxels"] <= voxels.stats(fine).first()["voxels"]


def test_roll_up_equals_direct_sums(spark):
    r = random.Random(3)
    rows = [(r.random(), r.random(), r.random()) for _ in range(200)] + [(0, 0, 0)]
    tree = Tree.adaptive(cloud.keyed(_cloud(spark, rows)), TreeParams(10, 20, 2)).settle()
    root = accum.roll_up(accum.leaf_sums(tree)).where("level = 0").first()
    low = [min(p[k] for p in rows) for k in range(3)]
    size = max(max(p[k] for p in rows) - low[k] for k in range(3))
    unit = [[(p[k] - low[k]) / size for k in range(3)] for p in rows if all((p[k] - low[k]) / size < 1 for k in range(3))]
    assert root["n"] == len(rows)
    assert root["sxy"] == pytest.approx(sum(u[0] * u[1] for u in unit), abs=3)


@pytest.mark.parametrize("rows,measure", [
    ([(i, j, 0.5) for i in range(5) for j in range(5)], "planarity"),
    ([(i, 2 * i, 3 * i) for i in range(20)], "linearity"),
])
def test_shapes(spark, rows, measure):
    tree = Tree.adaptive(cloud.keyed(_cloud(spark, [(x + 0.01, y + 0.01, z) for x, y, z in rows])), TreeParams(10_000)).settle()
    node = accum.shape(accum.roll_up(accum.leaf_sums(tree))).first()
    assert node["surface_variation"] < 0.05
    assert node[measure] > 0.5


def test_small_root_shows_nothing(spark):
    r = random.Random(2)
    tree_points = _cloud(spark, [(r.random(), r.random(), r.random()) for _ in range(50)])
    box = cloud.Box.of(tree_points)
    tree = Tree.adaptive(cloud.keyed(tree_points, box), TreeParams(5, 20, 2)).settle()
    nodes = select.visibility(tree, box, settings.Camera.orbit((1.0, 1.0, 1.0), 64, 36), 1e6)
    assert select.frontier(nodes).isEmpty()
    assert select.frontier(nodes, draw_root_if_small=True).count() == 1


def test_empty_cloud(spark):
    empty = _cloud(spark, [(0, 0, 0)]).where("seq < 0")
    assert Tree.adaptive(cloud.keyed(empty), TreeParams(5)).stats().first()["inner_nodes"] == 0
