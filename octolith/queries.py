"""All queries of the point engine with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith import oracle as sql
from octolith import settings as st
from octolith.functions import colour, geometry
from octolith.operators import accum, budget, cloud, profile, raster, refine, select, voxels
from octolith.operators.tree import Tree, cells_at, pyramid
from octolith.plans import pipelines, render, report
from octolith.session import shared_dir
from octolith.sources import synthetic, views
from octolith.streaming import batches

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_VIEWS = {"events": views.events, "embeddings": views.embeddings, "lineitem": views.lineitem}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _tree(spark: SparkSession, sf_dir: str, view: str = "events", settle: bool = True) -> tuple[Tree, DataFrame]:
    points = _VIEWS[view](spark, sf_dir)
    box = cloud.Box.of(points)
    tree = Tree.adaptive(cloud.keyed(points, box), st.TREES[view])
    return tree.settle() if settle else tree, box


# bounds, translation, keys


@query(sql.points("events") + " SELECT xmin, ymin, zmin, xmax, ymax, zmax, n, size FROM b")
def cloud_bounds(spark, sf_dir):
    return cloud.bounds(views.events(spark, sf_dir))


@query(sql.points("lineitem") + " SELECT xmin, ymin, zmin, xmax, ymax, zmax, n, size FROM b")
def cloud_bounds_lineitem(spark, sf_dir):
    return cloud.bounds(views.lineitem(spark, sf_dir))


@query(sql.points("events") + " SELECT seq, x - xmin x, y - ymin y, z - zmin z, rgba FROM p, b")
def cloud_translate(spark, sf_dir):
    return cloud.translate(views.events(spark, sf_dir))


_CLAMPED = ", ".join(f"greatest(0, least(CAST(floor(u{a} * 1048576) AS BIGINT), 1048575)) d{a}" for a in "xyz")


@query(sql.points("events") + f", q AS (SELECT seq, code, {_CLAMPED} FROM k) SELECT seq, code, {sql.morton('dx', 'dy', 'dz')} code_clamped FROM q")
def morton_codes(spark, sf_dir):
    return cloud.morton_codes(views.events(spark, sf_dir))


@query(sql.points("events") + f" SELECT seq, 'r' || array_to_string([(code >> (3 * (19 - i))) & 7 for i in range(0, {st.PATH_DEPTH})], '') path FROM k")
def octant_paths(spark, sf_dir):
    return cloud.octant_paths(views.events(spark, sf_dir), st.PATH_DEPTH)


@query(sql.points("events") + f" SELECT greatest(abs(xmax - xmin), abs(ymax - ymin), abs(zmax - zmin)) * {sql.num(2.0**-23)} error FROM b")
def quantisation_error(spark, sf_dir):
    return cloud.quantisation_error(views.events(spark, sf_dir))


@query(sql.points("events") + " SELECT seq, (rgba & 255)::BIGINT r, ((rgba >> 8) & 255)::BIGINT g, ((rgba >> 16) & 255)::BIGINT b, ((rgba >> 24) & 255)::BIGINT a FROM p")
def unpacked_colours(spark, sf_dir):
    return views.events(spark, sf_dir).select("seq", *[colour.channel(F.col("rgba"), k).alias(c) for k, c in enumerate("rgba")])


# the adaptive tree


@query(sql.tree("events") + " " + sql.NODE)
def octree_nodes(spark, sf_dir):
    df = _tree(spark, sf_dir, settle=False)[0].described()
    return df.withColumns({"level": F.col("level").cast("long"), "num_points": F.col("num_points").cast("long")})


@query(sql.tree("events") + ' SELECT level::BIGINT "level", code, n FROM nodes WHERE NOT is_inner')
def octree_leaves(spark, sf_dir):
    return _tree(spark, sf_dir, settle=False)[0].leaves().withColumn("level", F.col("level").cast("long"))


@query(sql.tree("events") + f" SELECT {sql.ALL_STATS} FROM nodes")
def octree_stats(spark, sf_dir):
    return _tree(spark, sf_dir, settle=False)[0].stats()


@query(sql.tree("embeddings") + f" SELECT {sql.ALL_STATS} FROM nodes")
def octree_stats_embeddings(spark, sf_dir):
    return _tree(spark, sf_dir, "embeddings", settle=False)[0].stats()


@query(sql.tree("lineitem") + f" SELECT {sql.ALL_STATS} FROM nodes")
def octree_stats_lineitem(spark, sf_dir):
    return _tree(spark, sf_dir, "lineitem", settle=False)[0].stats()


@query(sql.tree("events") + ' SELECT level::BIGINT "level", count(*) nodes, count_if(is_inner)::BIGINT inner_nodes, sum(CASE WHEN is_inner THEN 0 ELSE n END)::BIGINT points FROM nodes GROUP BY ALL')
def octree_level_histogram(spark, sf_dir):
    return _tree(spark, sf_dir, settle=False)[0].level_histogram()


@query(sql.tree("events") + ' SELECT k.seq, l.level::BIGINT "level", l.code leaf FROM k JOIN nodes l ON NOT l.is_inner AND k.code >> (3 * (20 - l.level)) = l.code')
def leaf_assignment(spark, sf_dir):
    return _tree(spark, sf_dir)[0].assigned().select("seq", F.col("level").cast("long").alias("level"), "leaf")


@query(sql.tree("events") + " SELECT max(level)::BIGINT depth FROM nodes")
def octree_depth(spark, sf_dir):
    return _tree(spark, sf_dir, settle=False)[0].nodes().agg(F.max("level").cast("long").alias("depth"))


# fixed depth


@query(sql.fixed("events", st.DEPTH) + " " + sql.NODE)
def fixed_depth_nodes(spark, sf_dir):
    df = Tree.fixed_depth(cloud.keyed(views.events(spark, sf_dir)), st.DEPTH).described()
    return df.withColumns({"level": F.col("level").cast("long"), "num_points": F.col("num_points").cast("long")})


@query(" UNION ALL ".join(f"SELECT {d}::BIGINT fixed_depth, s.* FROM ({sql.fixed('events', d)} SELECT {sql.STATS} FROM nodes) s" for d in range(2, 6)))
def fixed_depth_sweep(spark, sf_dir):
    points = cloud.keyed(views.events(spark, sf_dir))
    out = None
    for d in range(2, 6):
        row = Tree.fixed_depth(points, d).stats().drop("point_chunks", "over_capacity").withColumn("fixed_depth", F.lit(d).cast("long"))
        out = row if out is None else out.unionByName(row)
    return out


@query(sql.fixed("events", 6) + ' SELECT level::BIGINT "level", code, n FROM cnt')
def cell_pyramid(spark, sf_dir):
    df = pyramid(cells_at(cloud.keyed(views.events(spark, sf_dir)), 6), 6, 0)
    return df.withColumn("level", F.col("level").cast("long"))


# sample grids


@query(sql.voxels("events") + ' SELECT level::BIGINT "level", node, count(*) num_voxels FROM vox GROUP BY ALL')
def voxel_counts(spark, sf_dir):
    return voxels.counts(_tree(spark, sf_dir)[0]).withColumn("level", F.col("level").cast("long"))


_EDGE = "(size / pow(2, level))"
_CENTRES = ", ".join(f"round({a}min + {sql.gather('node', k)} * {_EDGE} + {_EDGE} * ((i{a} + 0.5e0) / {1 << st.TREES['events'].grid_bits}), 6) {a}" for k, a in enumerate("xyz"))


@query(sql.voxels("events") + f' SELECT level::BIGINT "level", node, ix, iy, iz, {_CENTRES}, rgba FROM vox, b')
def voxels_first_come(spark, sf_dir):
    tree, box = _tree(spark, sf_dir)
    return _rounded(voxels.first_come(tree, box), *"xyz").withColumn("level", F.col("level").cast("long"))


@query(sql.voxels("events") + ' SELECT level::BIGINT "level", node, ix, iy, iz, n, round(r::DOUBLE / n, 6) mean_r, round(g::DOUBLE / n, 6) mean_g, round(b::DOUBLE / n, 6) mean_b FROM vox')
def voxels_mean_colour(spark, sf_dir):
    df = voxels.mean_colour(_tree(spark, sf_dir)[0])
    return _rounded(df, "mean_r", "mean_g", "mean_b").withColumn("level", F.col("level").cast("long"))


@query(sql.voxels("lineitem") + ", v AS (SELECT level, node, count(*) num_voxels FROM vox GROUP BY ALL) SELECT sum(num_voxels)::BIGINT voxels, count(*) inner_nodes, min(num_voxels) least, max(num_voxels) most, sum(ceil(num_voxels / 1000))::BIGINT voxel_chunks FROM v")
def voxel_stats(spark, sf_dir):
    return voxels.stats(_tree(spark, sf_dir, "lineitem")[0])


# statistics of leaves and nodes


@query(sql.leaf_points("events") + ", g AS (" + sql.sums("lp", "level, leaf") + '), h AS (SELECT level, leaf, max(seq // 1000) last_batch FROM lp GROUP BY ALL) SELECT g.* REPLACE (level::BIGINT AS level), last_batch FROM g JOIN h USING (level, leaf)')
def leaf_accum(spark, sf_dir):
    df = accum.leaf_sums(_tree(spark, sf_dir)[0], st.BATCH)
    return _rounded(df, *accum.SUMS).withColumn("level", F.col("level").cast("long"))


@query(sql.leaf_points("events") + ", g AS (SELECT level, leaf, count(*) c FROM lp GROUP BY ALL) SELECT (SELECT sum(c) FROM g)::BIGINT sum_leaf_counts, 0::BIGINT inner_with_sums, count_if(NOT is_inner AND coalesce(c, 0) <> n)::BIGINT count_mismatches FROM nodes LEFT JOIN g ON g.level = nodes.level AND g.leaf = nodes.code")
def accum_verify(spark, sf_dir):
    tree = _tree(spark, sf_dir)[0]
    return accum.verify(tree, accum.leaf_sums(tree))


@query(sql.leaf_points("events") + f", q AS (SELECT {_CLAMPED} FROM k) SELECT (SELECT count(DISTINCT (level, leaf)) FROM lp) leaves_folded, (SELECT count(*) FROM lp) points_folded, (SELECT max({sql.morton('dx', 'dy', 'dz')}) FROM q) watermark")
def accum_globals(spark, sf_dir):
    return accum.totals(_tree(spark, sf_dir)[0])


def _rolled(spark, sf_dir) -> DataFrame:
    return accum.roll_up(accum.leaf_sums(_tree(spark, sf_dir)[0]))


@query(sql.rolled("events") + ' SELECT level::BIGINT "level", code, ' + ", ".join(f"round({s}, 6) {s}" for s in sql.SUMS) + ", n FROM rolled")
def accum_rollup(spark, sf_dir):
    return _rounded(_rolled(spark, sf_dir), *accum.SUMS).withColumn("level", F.col("level").cast("long"))


_SHAPES = ("surface_variation", "linearity", "planarity", "scattering")


@query(sql.shapes("events") + ' SELECT level::BIGINT "level", code, n, ' + ", ".join(f"round({c}, 6) {c}" for c in ("e_min", "e_mid", "e_max", *_SHAPES)) + " FROM shp")
def node_eigen_metrics(spark, sf_dir):
    df = accum.shape(_rolled(spark, sf_dir)).select(F.col("level").cast("long").alias("level"), "code", "n", "e_min", "e_mid", "e_max", *_SHAPES)
    return _rounded(df, "e_min", "e_mid", "e_max", *_SHAPES)


@query(sql.rolled("events") + ' SELECT level::BIGINT "level", code, n, ' + ", ".join(f"round(s{c}{c} / n - (s{c} / n) * (s{c} / n), 6) var_{c}" for c in "rgb") + " FROM rolled")
def node_colour_variance(spark, sf_dir):
    df = accum.colour_variance(_rolled(spark, sf_dir)).select(F.col("level").cast("long").alias("level"), "code", "n", "var_r", "var_g", "var_b")
    return _rounded(df, "var_r", "var_g", "var_b")


@query(sql.shapes("events") + f' SELECT level::BIGINT "level", code, round(sqrt(greatest(e_min, 0)) * size / pow(2, level), 4) residual FROM shp, b WHERE shp.n >= {st.LEAST_SHAPE_POINTS}')
def node_plane_residual(spark, sf_dir):
    df = accum.shape(_rolled(spark, sf_dir)).where(F.col("n") >= st.LEAST_SHAPE_POINTS)
    df = cloud.with_bounds(df, cloud.Box.of(views.events(spark, sf_dir)))
    return df.select(F.col("level").cast("long").alias("level"), "code", F.round(F.sqrt(F.greatest("e_min", F.lit(0.0))) * F.col("size") / F.pow(F.lit(2.0), F.col("level")), 4).alias("residual"))


_CROSS = " UNION ALL ".join(f"SELECT level, code, {a}1 * {b}2 - {a}2 * {b}1 x, {a}2 * {b}0 - {a}0 * {b}2 y, {a}0 * {b}1 - {a}1 * {b}0 z FROM rw" for a, b in ("rs", "rt", "st"))
_NORMAL = ", ".join(f"CASE WHEN v.l > 0 THEN round(v.{a} / sqrt(v.l) * s, 4) ELSE 0 END n{a}" for a in "xyz")


@query(sql.shapes("events") + f""",
rw AS (SELECT level, code, cxx - e_min r0, cxy r1, cxz r2, cxy s0, cyy - e_min s1, cyz s2, cxz t0, cyz t1, czz - e_min t2 FROM shp WHERE n >= {st.LEAST_SHAPE_POINTS}),
cr AS ({_CROSS}),
mx AS (SELECT level, code, max({{'l': x * x + y * y + z * z, 'x': x, 'y': y, 'z': z}}) v FROM cr GROUP BY ALL),
sg AS (SELECT *, CASE WHEN CASE WHEN abs(v.x) >= abs(v.y) AND abs(v.x) >= abs(v.z) THEN v.x WHEN abs(v.y) >= abs(v.z) THEN v.y ELSE v.z END < 0 THEN -1 ELSE 1 END s FROM mx)
SELECT level::BIGINT "level", code, {_NORMAL} FROM sg""")
def node_normals(spark, sf_dir):
    df = geometry.with_normals(accum.shape(_rolled(spark, sf_dir)).where(F.col("n") >= st.LEAST_SHAPE_POINTS))
    return _rounded(df.select(F.col("level").cast("long").alias("level"), "code", "nx", "ny", "nz"), "nx", "ny", "nz", digits=4)


# views


@query(sql.tree("events") + ' SELECT level::BIGINT "level", code, size / pow(2, level) edge, ' + ", ".join(f"{a}min + {sql.gather('code', k)} * (size / pow(2, level)) low_{a}" for k, a in enumerate("xyz")) + " FROM nodes, b")
def node_bounds(spark, sf_dir):
    tree, box = _tree(spark, sf_dir, settle=False)
    return select.node_bounds(tree.nodes(), box).select(F.col("level").cast("long").alias("level"), "code", "edge", "low_x", "low_y", "low_z")


def _visible(spark, sf_dir) -> tuple[Tree, DataFrame, DataFrame]:
    tree, box = _tree(spark, sf_dir)
    return tree, box, select.visibility(tree, box, st.CAMERA, st.PIXELS)


@query(sql.visible("events") + ' SELECT level::BIGINT "level", code, samples::BIGINT samples, round(dx, 6) dx, round(dy, 6) dy, visible, "large" FROM vis')
def node_visibility(spark, sf_dir):
    df = _visible(spark, sf_dir)[2].select(F.col("level").cast("long").alias("level"), "code", "samples", "dx", "dy", "visible", "large")
    return _rounded(df, "dx", "dy")


@query(sql.visible("events") + ' SELECT level::BIGINT "level", code, is_inner, samples::BIGINT samples FROM front')
def lod_frontier(spark, sf_dir):
    return select.frontier(_visible(spark, sf_dir)[2]).select(F.col("level").cast("long").alias("level"), "code", "is_inner", "samples")


@query(sql.visible("events") + " SELECT count(*) items, coalesce(sum(samples), 0)::BIGINT samples, count(*) > 50 overflow FROM front")
def frontier_totals(spark, sf_dir):
    return select.totals(select.frontier(_visible(spark, sf_dir)[2]), 50)


@query(f"SELECT CAST(floor(event_id / {st.BATCH}) AS BIGINT) slice, count(*) samples FROM events GROUP BY ALL")
def flat_slices(spark, sf_dir):
    return select.flat_slices(views.events(spark, sf_dir), st.BATCH)


@query(sql.visible("events") + ", e AS (SELECT front.*, unnest(range(0, 12)) edge_no FROM front), f AS (SELECT *, edge_no // 4 ax, (edge_no % 4) // 2 s1, edge_no % 2 s2 FROM e) SELECT level::BIGINT \"level\", code, edge_no, " + ", ".join(f"low_{a} + (CASE WHEN ax = {k} THEN {far} WHEN {k} = CASE WHEN ax = 0 THEN 1 ELSE 0 END THEN s1 ELSE s2 END) * edge {a}{far}" for far in (0, 1) for k, a in enumerate("xyz")) + " FROM f")
def node_box_edges(spark, sf_dir):
    df = select.box_edges(select.frontier(_visible(spark, sf_dir)[2]))
    return df.withColumns({"level": F.col("level").cast("long"), "edge_no": F.col("edge_no").cast("long")})


@query()
def wireframe_pixels(spark, sf_dir):
    return raster.wireframe(select.box_edges(select.frontier(_visible(spark, sf_dir)[2])), st.CAMERA)


# images


def _moved(spark, sf_dir) -> DataFrame:
    return cloud.translate(views.events(spark, sf_dir))


@query(sql.points("events") + ", " + sql.moved() + ", " + sql.fragments("mv") + " SELECT px, py, round(depth, 6) depth, rgba FROM img")
def raster_flat(spark, sf_dir):
    return _rounded(raster.pixels(_moved(spark, sf_dir), st.CAMERA), "depth")


@query(sql.lod_samples("events") + ", " + sql.fragments("smp") + " SELECT px, py, round(depth, 6) depth, rgba FROM img")
def raster_lod(spark, sf_dir):
    tree, box, nodes = _visible(spark, sf_dir)
    return _rounded(raster.pixels(select.samples(tree, select.frontier(nodes), box), st.CAMERA), "depth")


@query(sql.points("events") + ", " + sql.moved() + ", " + sql.fragments("mv") + ", " + sql.EDL + " SELECT px, py, round(depth, 6) depth, round(shade, 6) shade FROM edl")
def raster_edl(spark, sf_dir):
    df = raster.shaded(raster.pixels(_moved(spark, sf_dir), st.CAMERA)).select("px", "py", "depth", "shade")
    return _rounded(df, "depth", "shade")


@query(sql.points("events") + ", " + sql.moved() + ", " + sql.fragments("mv") + f" SELECT a.px, b2.py, coalesce(img.rgba, {colour.CLEAR}) rgba FROM (SELECT unnest(range(0, {st.IMAGE[0]})) px) a CROSS JOIN (SELECT unnest(range(0, {st.IMAGE[1]})) py) b2 LEFT JOIN img ON img.px = a.px AND img.py = b2.py")
def image_resolve(spark, sf_dir):
    return raster.resolved(raster.pixels(_moved(spark, sf_dir), st.CAMERA), st.CAMERA)


@query(sql.points("events") + ", " + sql.moved() + ", " + sql.fragments("mv") + " SELECT rgba, count(*) pixels FROM img GROUP BY ALL")
def image_histogram(spark, sf_dir):
    return raster.pixels(_moved(spark, sf_dir), st.CAMERA).groupBy("rgba").agg(F.count("*").alias("pixels"))


@query(sql.lod_samples("events") + ", " + sql.fragments("smp") + f" SELECT a.px, b2.py, coalesce(img.rgba, {colour.CLEAR}) rgba FROM (SELECT unnest(range(0, {st.IMAGE[0]})) px) a CROSS JOIN (SELECT unnest(range(0, {st.IMAGE[1]})) py) b2 LEFT JOIN img ON img.px = a.px AND img.py = b2.py")
def render_frame(spark, sf_dir):
    built = pipelines.Built(*_tree(spark, sf_dir))
    return render.frame(built, st.CAMERA, render.Options(st.PIXELS, shade=0.0))


@query()
def render_frame_with_boxes(spark, sf_dir):
    built = pipelines.Built(*_tree(spark, sf_dir))
    return render.frame(built, st.CAMERA, render.Options(st.PIXELS, point_size=3, colour="level", show_boxes=True))


@query(sql.leaf_points("events") + f" SELECT seq FROM lp WHERE ({st.OCTANT_MASK} >> (CASE WHEN lx >= 5e-1 THEN 1 ELSE 0 END + CASE WHEN ly >= 5e-1 THEN 2 ELSE 0 END + CASE WHEN lz >= 5e-1 THEN 4 ELSE 0 END)) & 1 = 1")
def octant_mask_filter(spark, sf_dir):
    points = accum.local(_tree(spark, sf_dir)[0].assigned(), F.col("level"))
    return select.octant_kept(points, st.OCTANT_MASK).select("seq")


_GRIDS = sql.voxels("events")


@query(_GRIDS + f""", s AS (SELECT {sql.STATS} FROM nodes), v AS (SELECT count(*) voxels FROM vox), c AS (SELECT sum(CASE WHEN is_inner THEN 0 ELSE ceil(n / 1000) END) point_chunks FROM nodes),
r AS (SELECT *, points * 26 + least(50, ceil(points / 1000000)) * 16000000 + {budget.FIXED} required FROM s, v, c)
SELECT unnest(['points', 'nodes', 'inner_nodes', 'leaves', 'nonempty_leaves', 'max_points_per_leaf', 'depth', 'point_chunks', 'voxels', 'over_capacity', 'over_draw_list', 'nodes_add_up', 'predicted_percent', 'required_bytes']) "name",
 unnest([points, nodes, inner_nodes, leaves, nonempty_leaves, max_points_per_leaf, depth, point_chunks, voxels, 0, 0, 1, 0, required]::DOUBLE[]) "value" FROM r""")
def build_report(spark, sf_dir):
    return report.build_report(pipelines.Built(*_tree(spark, sf_dir)), 6_000_000_000)


# batches and streams


@query(sql.points("events") + f""",
c AS (SELECT CAST(floor(seq / {st.BATCH}) AS BIGINT) batch, level, code >> (3 * (20 - level)) code, count(*) n FROM k, (SELECT unnest(range(0, 20)) level) GROUP BY ALL),
bt AS (SELECT DISTINCT batch FROM c),
s AS (SELECT bt.batch, level, code, sum(n) n FROM bt JOIN c ON c.batch <= bt.batch GROUP BY ALL)
SELECT batch, sum(CASE WHEN level = 0 THEN n END)::BIGINT points, count_if(n > {st.TREES['events'].threshold})::BIGINT inner_nodes, (8 * count_if(n > {st.TREES['events'].threshold}) + 1)::BIGINT nodes FROM s GROUP BY batch""")
def progressive_octree(spark, sf_dir):
    return batches.progressive(cloud.keyed(views.events(spark, sf_dir)), st.TREES["events"], st.BATCH, st.TREES["events"].max_depth)


@query(ORACLE["progressive_octree"].replace("SELECT batch, sum(", "SELECT count(*) batches, max(points) points, max(inner_nodes) splits, round(max(inner_nodes)::DOUBLE / count(*), 6) splits_per_batch FROM (SELECT batch, sum(") + ")")
def batch_ratios(spark, sf_dir):
    df = batches.progressive(cloud.keyed(views.events(spark, sf_dir)), st.TREES["events"], st.BATCH, st.TREES["events"].max_depth)
    df = df.agg(F.count("*").alias("batches"), F.max("points").alias("points"), F.max("inner_nodes").alias("splits"))
    return df.withColumn("splits_per_batch", F.round(F.col("splits") / F.col("batches"), 6))


@query(f"SELECT CAST(floor(event_id / {st.BATCH}) AS BIGINT) batch, count(*) points, batch % {st.SLOTS} slot, batch // {st.SLOTS} \"round\", CASE WHEN batch >= {st.SLOTS} THEN batch - {st.SLOTS} END replaces FROM events GROUP BY batch")
def batch_ring_schedule(spark, sf_dir):
    return batches.schedule(views.events(spark, sf_dir), st.BATCH, st.SLOTS)


@query(sql.leaf_points("events") + f', m AS (SELECT max(seq // {st.BATCH}) cur FROM k), g AS (SELECT level, leaf, count(*) n, max(seq // {st.BATCH}) last_batch FROM lp GROUP BY ALL) SELECT level::BIGINT "level", leaf, n, last_batch, cur - last_batch age, CASE WHEN cur - last_batch >= {st.CLOSE_MARGIN} THEN \'closed\' ELSE \'open\' END state FROM g, m')
def closure_by_batch_age(spark, sf_dir):
    tree = _tree(spark, sf_dir)[0]
    current = tree.codes.agg(F.max(F.floor(F.col("seq") / st.BATCH))).first()[0]
    df = batches.closed(accum.leaf_sums(tree, st.BATCH), current, st.CLOSE_MARGIN)
    return df.withColumn("level", F.col("level").cast("long"))


@query(sql.points("events") + f", t AS (SELECT * FROM k WHERE seq < 3 * {st.BATCH}), c AS (SELECT level, code >> (3 * (20 - level)) code, count(*) n FROM t, (SELECT unnest(range(0, 20)) level) GROUP BY ALL) SELECT count_if(n > {st.TREES['events'].threshold})::BIGINT inner_nodes, (8 * count_if(n > {st.TREES['events'].threshold}) + 1)::BIGINT nodes, sum(CASE WHEN level = 0 THEN n END)::BIGINT points FROM c")
def truncated_build(spark, sf_dir):
    points = views.events(spark, sf_dir)
    part = cloud.keyed(batches.truncated(points, st.BATCH, 3), cloud.Box.of(points))
    return Tree.adaptive(part, st.TREES["events"]).stats().select("inner_nodes", "nodes", "points")


@query(sql.tree("events") + f' SELECT level::BIGINT "level", code, n FROM cnt WHERE n > {st.TREES["events"].threshold} AND level < 20')
def stream_equals_batch(spark, sf_dir):
    """The inner nodes that a stream over the events arrives at; a Structured Streaming query is run to its end."""
    return _streamed(spark, sf_dir, batches.CellState).inner(spark, st.TREES["events"].threshold).withColumn("level", F.col("level").cast("long"))


@query(ORACLE["leaf_accum"])
def stream_accum(spark, sf_dir):
    """Sums of leaves carried by a stream from batch to batch, equal to those of one build."""
    df = _streamed(spark, sf_dir, batches.SumState, batch_points=st.BATCH).leaf_sums(spark, st.TREES["events"].threshold)
    return _rounded(df, *accum.SUMS).withColumn("level", F.col("level").cast("long"))


def _streamed(spark, sf_dir, kind, **more):
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    points = views.events(spark, sf_dir)
    box = cloud.bounds(points).first()
    state = kind(f"{folder}/state", st.TREES["events"].max_depth, (box["xmin"], box["ymin"], box["zmin"], box["size"]), **more)
    points.repartition(4, "seq").write.option("maxRecordsPerFile", 5000).parquet(f"{folder}/in")
    batches.run_stream(spark, f"{folder}/in", points.schema.simpleString()[7:-1].replace(":", " "), state, f"{folder}/checkpoint", 2)
    return state


# budgets


_VALUES = ", ".join(f"('{p}', {n}::BIGINT, {b}::BIGINT, {str(r).lower()})" for p, n, b, r in st.ADMISSION)
_ADMIT = f"""WITH v(pipeline, points, budget, resident) AS (VALUES {_VALUES}),
i AS (SELECT *, CASE WHEN resident THEN points * 16 ELSE least(50, CAST(ceil(points / 1000000) AS BIGINT)) * 16000000 END::BIGINT input_bytes FROM v),
o AS (SELECT *, input_bytes + {budget.FIXED} + 536870912 refusal_floor, points * 26 + input_bytes + {budget.FIXED} required_bytes FROM i),
c AS (SELECT *, refusal_floor <= budget fits, greatest(0, least(points * 48, greatest(0, budget - input_bytes - {budget.FIXED})) - 200000000) usable FROM o)"""


def _requests(spark):
    return spark.createDataFrame(st.ADMISSION, "pipeline string, points long, budget long, resident boolean")


@query(_ADMIT + f" SELECT pipeline, points, budget, resident, input_bytes, required_bytes, refusal_floor, fits, least(greatest(points * 48, 536870912), greatest(0, budget - input_bytes - {budget.FIXED})) store_bytes, fits AND NOT (resident AND points > 50000000) admitted FROM c")
def budget_admission(spark, sf_dir):
    return budget.admission(_requests(spark)).drop("completion", "reason", "warning")


@query(_ADMIT + " SELECT pipeline, points, budget, round(least(1, usable / 26e0 / points), 6) completion, CASE WHEN least(1, usable / 26e0 / points) < 0.999 THEN 'ingest will stop early' ELSE '' END warning FROM c")
def predicted_completion(spark, sf_dir):
    return _rounded(budget.admission(_requests(spark)).select("pipeline", "points", "budget", "completion", "warning"), "completion")


# timing


def _samples(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select(F.col("event_type").alias("scope"), F.col("value").alias("ms"), F.col("event_id").alias("seq"))


@query('SELECT event_type "scope", count(*) n, round(avg(value), 6) mean, round(coalesce(var_samp(value), 0), 6) variance, min(value) least, max(value) most, arg_max(value, event_id) "last", round(sum(value), 4) total FROM events GROUP BY ALL')
def scope_stats(spark, sf_dir):
    return profile.scope_stats(_samples(spark, sf_dir)).withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 6), "total": F.round("total", 4)})


@query('SELECT event_type "scope", quantile_disc(value, 0.5) p50, quantile_disc(value, 0.95) p95, quantile_disc(value, 0.99) p99 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) age FROM events) WHERE age <= 4096 GROUP BY ALL')
def scope_percentiles(spark, sf_dir):
    return profile.percentiles(_samples(spark, sf_dir))


@query('SELECT event_type "scope", event_id seq, round(avg(value) OVER w, 9) mean, max(value) OVER w most FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 239 PRECEDING AND CURRENT ROW)')
def moving_frames(spark, sf_dir):
    return _rounded(profile.moving(_samples(spark, sf_dir)), "mean", digits=9)


@query("""WITH m AS (SELECT user_id, event_type phase, CAST(epoch_us(ts) AS BIGINT) ns, event_id i FROM events),
s AS (SELECT *, lead(ns) OVER (PARTITION BY user_id ORDER BY i) - ns span FROM m),
t AS (SELECT phase, sum(span)::BIGINT ns, count(*) spans, count(DISTINCT user_id) launches FROM s WHERE span >= 0 GROUP BY phase)
SELECT phase, ns, spans, launches, round(ns * 100e0 / sum(ns) OVER (), 6) percent FROM t""")
def phase_durations(spark, sf_dir):
    marks = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("launch"), F.col("event_id").alias("i"), F.col("event_type").alias("phase"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ns"))
    return _rounded(profile.phase_durations(marks), "percent")


@query('SELECT event_type "scope", count(*) points, round(count(*) / 1e6 / (sum(value) / 1000e0), 9) mps FROM events GROUP BY ALL')
def throughput(spark, sf_dir):
    df = _samples(spark, sf_dir).groupBy("scope").agg(F.count("*").alias("points"), F.sum("ms").alias("ms"))
    return df.select("scope", "points", F.round(profile.throughput(F.col("points"), F.col("ms")), 9).alias("mps"))


@query("SELECT round(sum(value), 4) total, count(*) n, count(*) > 0 measured FROM events WHERE event_type IN ('click', 'view')")
def build_totals(spark, sf_dir):
    df = profile.build_totals(profile.scope_stats(_samples(spark, sf_dir)), ["click", "view"])
    return df.withColumn("total", F.round("total", 4))


# refinement and quality (extensions)


def _scores(spark, sf_dir) -> DataFrame:
    tree, box, nodes = _visible(spark, sf_dir)
    shapes = accum.shape(accum.roll_up(accum.leaf_sums(tree)))
    scores = refine.scored(shapes, nodes.where(~F.col("is_inner")), st.CAMERA)
    return scores.withColumn("score", F.round("score", 9))


_VIS_PART = sql.visible("events")[len(sql.tree("events")):]


@query(sql.shapes("events") + _VIS_PART + f""",
sc AS (SELECT shp.level, shp.code, shp.n, round(surface_variation * least(1, dx * dy / {float(st.IMAGE[0] * st.IMAGE[1])}), 9) score FROM shp JOIN vis USING (level, code) WHERE vis.visible AND NOT vis.is_inner),
o AS (SELECT row_number() OVER w "position", level, code, score, sum(n) OVER w "cost" FROM sc WINDOW w AS (ORDER BY score DESC, level, code ROWS UNBOUNDED PRECEDING))
SELECT "position", level::BIGINT "level", code, score, "cost"::BIGINT "cost" FROM o WHERE "cost" <= {st.QUEUE_POINTS}""")
def refinement_queue(spark, sf_dir):
    return refine.queue(_scores(spark, sf_dir), st.QUEUE_POINTS).withColumn("level", F.col("level").cast("long"))


@query(sql.shapes("events") + f' SELECT shp.level::BIGINT "level", shp.code, nodes.n, round(surface_variation, 6) surface_variation FROM shp JOIN nodes USING (level, code) WHERE NOT nodes.is_inner AND nodes.n >= {st.DEEPEN[1]} AND round(surface_variation, 9) >= {st.DEEPEN[0]}')
def deepen_candidates(spark, sf_dir):
    tree = _tree(spark, sf_dir)[0]
    shapes = accum.shape(_rolled(spark, sf_dir)).withColumn("surface_variation", F.round("surface_variation", 9))
    df = refine.deepen(tree.leaves(), shapes, *st.DEEPEN)
    return _rounded(df, "surface_variation").withColumn("level", F.col("level").cast("long"))


@query(sql.shapes("events") + f' SELECT q.level::BIGINT "level", q.code, q.n, round(surface_variation, 6) surface_variation FROM nodes q JOIN shp USING (level, code) WHERE q.is_inner AND round(surface_variation, 9) <= {st.COLLAPSE} AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.is_inner AND c.level = q.level + 1 AND c.code >> 3 = q.code)')
def collapse_candidates(spark, sf_dir):
    tree = _tree(spark, sf_dir)[0]
    shapes = accum.shape(_rolled(spark, sf_dir)).withColumn("surface_variation", F.round("surface_variation", 9))
    df = refine.collapse(tree.nodes(), shapes, st.COLLAPSE)
    return _rounded(df, "surface_variation").withColumn("level", F.col("level").cast("long"))


_GRID = ", ".join(f"{a}min + {sql.gather('node', k)} * {_EDGE} + {_EDGE} * ((i{a} + 0.5e0) / {1 << st.TREES['embeddings'].grid_bits}) {a}" for k, a in enumerate("xyz"))
_BETWEEN = "min(sqrt((a.x - t.x) * (a.x - t.x) + (a.y - t.y) * (a.y - t.y) + (a.z - t.z) * (a.z - t.z))) d"
_CLOUDS = sql.voxels("embeddings") + f""",
a AS (SELECT seq, x, y, z FROM p), t AS (SELECT node * 512 + ix * 64 + iy * 8 + iz id, {_GRID} FROM vox, b WHERE level = 1),
fw AS (SELECT a.seq, {_BETWEEN} FROM a, t GROUP BY a.seq), bw AS (SELECT t.id, {_BETWEEN} FROM a, t GROUP BY t.id)"""


def _pair(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A cloud, and the samples that stand for it at level 1 of its tree."""
    tree, box = _tree(spark, sf_dir, "embeddings")
    full = views.embeddings(spark, sf_dir).withColumnRenamed("seq", "id")
    number = F.col("node") * 512 + F.col("ix") * 64 + F.col("iy") * 8 + F.col("iz")
    return full, voxels.first_come(tree, box).where("level = 1").select(number.alias("id"), "x", "y", "z")


@query(_CLOUDS + " SELECT round(f, 6) forward, round(g, 6) backward, round(f + g, 6) chamfer FROM (SELECT avg(d) f FROM fw), (SELECT avg(d) g FROM bw)")
def chamfer_distance(spark, sf_dir):
    return _rounded(refine.chamfer(*_pair(spark, sf_dir)), "forward", "backward", "chamfer")


@query(_CLOUDS + " SELECT round(f, 6) forward, round(g, 6) backward, round(greatest(f, g), 6) hausdorff FROM (SELECT max(d) f FROM fw), (SELECT max(d) g FROM bw)")
def hausdorff_distance(spark, sf_dir):
    return _rounded(refine.hausdorff(*_pair(spark, sf_dir)), "forward", "backward", "hausdorff")


# sources


@query()
def synthetic_cloud(spark, sf_dir):
    return synthetic.cloud(spark, 20_000)


_WRAP = "18446744073709551616::UHUGEINT"
_CHANNEL = [f"({colour.HASH_LOW} + ((h >> {s}) & 255) * {colour.HASH_RANGE} // 255)" for s in (0, 8, 16)]


@query(f"""WITH l AS (SELECT unnest(range(0, 21)) "level"),
a AS (SELECT "level", ((("level" * {colour.LEVEL_STEP})::UHUGEINT + {colour.HASH_STEP}::UHUGEINT) % {_WRAP} * {colour.HASH_STEP}::UHUGEINT % {_WRAP})::UBIGINT h FROM l),
b AS (SELECT "level", (xor(h, h >> {colour.HASH_SHIFTS[0]})::UHUGEINT * {colour.HASH_FACTOR}::UHUGEINT % {_WRAP})::UBIGINT h FROM a),
c AS (SELECT "level", xor(h, h >> {colour.HASH_SHIFTS[1]}) h FROM b)
SELECT "level", ({_CHANNEL[0]} + {_CHANNEL[1]} * 256 + {_CHANNEL[2]} * 65536 + 255 * 16777216::BIGINT)::BIGINT rgba FROM c""")
def level_colours(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(colour.level_colours())), "level long, rgba long")
