"""DuckDB SQL of the registered queries, put together from common table expressions."""

from __future__ import annotations

from octolith.sources.views import EVENT_COLOURS, OTHER_COLOUR
from octolith.settings import CAMERA, PIXELS, SHAPE_FLOOR, TREES

EVENTS = "SELECT CAST(event_id AS BIGINT) seq, CAST(user_id AS DOUBLE) x, CAST(value AS DOUBLE) y, epoch(ts)/3600.0 - epoch(TIMESTAMP '2024-01-01')/3600.0 z, CAST(CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_COLOURS.items()) + f" ELSE {OTHER_COLOUR} END AS BIGINT) rgba FROM events"
EMBEDDINGS = "SELECT CAST(vec_id AS BIGINT) seq, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y, CAST(embedding[3] AS DOUBLE) z, CAST(label * 25 + (255 - label * 25) * 256 + 128 * 65536 + 255::BIGINT * 16777216 AS BIGINT) rgba FROM embeddings"
LINEITEM = "SELECT CAST(NULL AS BIGINT) seq, l_extendedprice / 1000 x, CAST(l_quantity AS DOUBLE) y, l_discount * 1000 z, CAST(ascii(l_returnflag) + ascii(l_linestatus) * 256 + 255::BIGINT * 16777216 AS BIGINT) rgba FROM lineitem"
POINTS = {"events": EVENTS, "embeddings": EMBEDDINGS, "lineitem": LINEITEM}


def num(v: float) -> str:
    """A literal that is read as a double."""
    return f"({v:.17e})"


def spread(c: str) -> str:
    return f"list_sum([(({c} >> i) & 1) << (3 * i) for i in range(0, 20)])::BIGINT"


def gather(code: str, axis: int) -> str:
    return f"list_sum([(({code} >> (3 * i + {2 - axis})) & 1) << i for i in range(0, 20)])::BIGINT"


def morton(x: str, y: str, z: str) -> str:
    return f"({spread(x)} * 4 + {spread(y)} * 2 + {spread(z)})"


def points(view: str) -> str:
    return f"""WITH p AS MATERIALIZED (SELECT * FROM ({POINTS[view]}) WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
b AS MATERIALIZED (SELECT min(x) xmin, min(y) ymin, min(z) zmin, max(x) xmax, max(y) ymax, max(z) zmax, count(*) n,
 CASE WHEN greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) > 0 THEN greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) ELSE 1e0 END size FROM p),
k AS MATERIALIZED (SELECT seq, x, y, z, rgba, (x - xmin) / size ux, (y - ymin) / size uy, (z - zmin) / size uz,
 CAST(floor(ux * 1048576) AS BIGINT) & 1048575 cx, CAST(floor(uy * 1048576) AS BIGINT) & 1048575 cy, CAST(floor(uz * 1048576) AS BIGINT) & 1048575 cz,
 {morton('cx', 'cy', 'cz')} code FROM p, b)"""


def tree(view: str) -> str:
    """Points, cell counts, inner nodes and nodes of the adaptive tree."""
    return f"""{points(view)},
cnt AS MATERIALIZED (SELECT level, code >> (3 * (20 - level)) code, count(*) n FROM k, (SELECT unnest(range(0, 21)) level) GROUP BY ALL),
inn AS MATERIALIZED (SELECT level, code FROM cnt WHERE n > {TREES[view].threshold} AND level < 20),
{_NODES.format(over=f"coalesce(n, 0) > {TREES[view].threshold} AND level < 20")}"""


_NODES = """nodes AS MATERIALIZED (SELECT level, code, coalesce(n, 0)::BIGINT n, {over} is_inner FROM (
 SELECT 0::BIGINT level, 0::BIGINT code UNION ALL SELECT level + 1, code * 8 + o FROM inn, (SELECT unnest(range(0, 8)) o)) LEFT JOIN cnt USING (level, code))"""


def fixed(view: str, depth: int) -> str:
    return f"""{points(view)},
cnt AS MATERIALIZED (SELECT level, code >> (3 * (20 - level)) code, count(*) n FROM k, (SELECT unnest(range(0, {depth + 1})) level) GROUP BY ALL),
inn AS MATERIALIZED (SELECT level, code FROM cnt WHERE level < {depth}),
{_NODES.format(over=f"coalesce(n, 0) > 0 AND level < {depth}")}"""


NAME = "'r' || array_to_string([(code >> (3 * (level - 1 - i))) & 7 for i in range(0, level)], '')"
NODE = f"SELECT level::BIGINT \"level\", code, {gather('code', 0)} cx, {gather('code', 1)} cy, {gather('code', 2)} cz, n, is_inner, NOT is_inner is_leaf, CASE WHEN is_inner THEN 0 ELSE n END::BIGINT num_points, {NAME} \"name\" FROM nodes"
STATS = "count(*) nodes, count_if(is_inner)::BIGINT inner_nodes, count_if(NOT is_inner)::BIGINT leaves, count_if(NOT is_inner AND n > 0)::BIGINT nonempty_leaves, sum(CASE WHEN is_inner THEN 0 ELSE n END)::BIGINT points, max(CASE WHEN NOT is_inner THEN n END)::BIGINT max_points_per_leaf, max(level)::BIGINT depth"
ALL_STATS = STATS + ", sum(CASE WHEN is_inner THEN 0 ELSE ceil(n / 1000) END)::BIGINT point_chunks, count(*) > 200000 over_capacity"


def voxels(view: str) -> str:
    bits = TREES[view].grid_bits
    cell = ", ".join(f"CAST(floor(u{a} * pow(2, level + {bits})) AS BIGINT) % {1 << bits} i{a}" for a in "xyz")
    sums = ", ".join(f"sum((rgba >> {8 * k}) & 255)::BIGINT {c}" for k, c in enumerate("rgb"))
    return f"""{tree(view)},
vox AS MATERIALIZED (SELECT i.level level, i.code node, {cell}, arg_min(rgba, seq) rgba, count(*) n, {sums} FROM inn i JOIN k ON k.code >> (3 * (20 - i.level)) = i.code GROUP BY i.level, i.code, ix, iy, iz)"""


SUMS = ("sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz", "sr", "sg", "sb", "srr", "sgg", "sbb")
_TERMS = ("lx", "ly", "lz", "lx * lx", "lx * ly", "lx * lz", "ly * ly", "ly * lz", "lz * lz", *[f"cc{c}" for c in "rgb"], *[f"cc{c} * cc{c}" for c in "rgb"])


def leaf_points(view: str) -> str:
    """Points with their leaf and coordinates in its cube."""
    local = ", ".join(f"greatest(0, least(1, u{a} * pow(2, level) - {gather('leaf', k)})) l{a}" for k, a in enumerate("xyz"))
    tint = ", ".join(f"((rgba >> {8 * k}) & 255) / 255e0 cc{c}" for k, c in enumerate("rgb"))
    return f"""{tree(view)},
lp AS MATERIALIZED (SELECT k.*, l.level, l.code leaf, {local}, {tint} FROM k JOIN nodes l ON NOT l.is_inner AND k.code >> (3 * (20 - l.level)) = l.code)"""


def sums(source: str, by: str, digits: int | None = 6) -> str:
    cast = (lambda t: f"round(sum({t}), {digits})") if digits is not None else (lambda t: f"sum({t})")
    return f"SELECT {by}, " + ", ".join(f"{cast(t)} {s}" for t, s in zip(_TERMS, SUMS)) + f", count(*) n FROM {source} GROUP BY {by}"


def rolled(view: str) -> str:
    """Sums of all nodes with points: coordinates in a leaf's cube moved up to each ancestor's."""
    up = ", ".join(f"(l{a} + ({gather('leaf', k)} & ((1::BIGINT << d) - 1))) / pow(2, d) l{a}" for k, a in enumerate("xyz"))
    return f"""{leaf_points(view)},
anc AS (SELECT lp.level - d level, leaf >> (3 * d) code, {up}, ccr, ccg, ccb FROM lp, (SELECT unnest(range(0, 21)) d) WHERE d <= lp.level),
rolled AS MATERIALIZED ({sums('anc', 'level, code', None)})"""


def shapes(view: str) -> str:
    c = ", ".join(f"s{a}{b} / n - (s{a} / n) * (s{b} / n) c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
    return f"""{rolled(view)},
cov AS (SELECT level, code, n, {c}, (cxx + cyy + czz) / 3 q FROM rolled WHERE n > 0),
ep AS (SELECT *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) p FROM cov),
ef AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1, least(1, ((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)) / (p * p * p) / 2))) / 3 ELSE 0 END phi FROM ep),
eg AS (SELECT *, q + 2 * p * cos(phi) e_max, q + 2 * p * cos(phi + 2 * pi() / 3) e_min, 3 * q - e_max - e_min e_mid, cxx + cyy + czz total FROM ef),
shp AS MATERIALIZED (SELECT *, {_ratio('e_min', 'total')} surface_variation, {_ratio('e_max - e_mid', 'e_max')} linearity, {_ratio('e_mid - e_min', 'e_max')} planarity, {_ratio('e_min', 'e_max')} scattering FROM eg)"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > {SHAPE_FLOOR} THEN ({a}) / ({b}) ELSE 0 END"


def clip(x: str, y: str, z: str, k: int) -> str:
    m = CAMERA.matrix[k]
    return f"({x} * {num(m[0])} + {y} * {num(m[1])} + {z} * {num(m[2])} + {num(m[3])})"


def pixel(c: str, w: str, extent: int) -> str:
    return f"(({c} / {w} * 5e-1 + 5e-1) * {num(extent)})"


def visible(view: str) -> str:
    """Nodes with their cube, samples, screen extent and the two tests."""
    planes = " AND ".join("(" + " + ".join(f"(low_{a}{' + edge' if n >= 0 else ''}) * {num(n)}" for a, n in zip("xyz", p[:3])) + f" + {num(p[3])} >= 0)" for p in CAMERA.planes())
    corners = [[f"(low_{a}{' + edge' if c >> k & 1 else ''})" for k, a in enumerate("xyz")] for c in range(8)]
    xs, ys = [], []
    for p in corners:
        w = clip(*p, 3)
        xs.append(f"CASE WHEN {w} > 0 THEN {pixel(clip(*p, 0), w, CAMERA.width)} END")
        ys.append(f"CASE WHEN {w} > 0 THEN {pixel(clip(*p, 1), w, CAMERA.height)} END")
    extent = lambda v: f"coalesce(greatest({', '.join(v)}) - least({', '.join(v)}), 0)"
    low = ", ".join(f"0e0 + {gather('code', k)} * edge low_{a}" for k, a in enumerate("xyz"))
    return f"""{voxels(view)},
nv AS (SELECT level, node code, count(*) num_voxels FROM vox GROUP BY ALL),
nb AS (SELECT nodes.*, CASE WHEN is_inner THEN coalesce(num_voxels, 0) ELSE nodes.n END samples, size / pow(2, level) edge, {low} FROM nodes LEFT JOIN nv USING (level, code), b),
vis AS MATERIALIZED (SELECT *, {extent(xs)} dx, {extent(ys)} dy, samples > 0 AND {planes} visible, dx > {PIXELS} OR dy > {PIXELS} "large" FROM nb),
front AS (SELECT v.* FROM vis v WHERE v.visible AND NOT v."large" AND EXISTS (SELECT 1 FROM vis q WHERE q.is_inner AND q."large" AND q.level + 1 = v.level AND q.code = v.code >> 3)
 UNION ALL SELECT * FROM vis WHERE visible AND "large" AND NOT is_inner)"""


def fragments(source: str) -> str:
    """Pixels of samples ``x, y, z`` (from the box's corner) with their depth."""
    return f"""fr AS (SELECT CAST(trunc({pixel(clip('x', 'y', 'z', 0), clip('x', 'y', 'z', 3), CAMERA.width)}) AS BIGINT) px, CAST(trunc({pixel(clip('x', 'y', 'z', 1), clip('x', 'y', 'z', 3), CAMERA.height)}) AS BIGINT) py, {clip('x', 'y', 'z', 3)} depth, rgba FROM {source} WHERE {clip('x', 'y', 'z', 3)} > 0),
pix AS (SELECT px, py, min({{'depth': depth, 'rgba': rgba}}) m FROM fr WHERE px >= 0 AND px < {CAMERA.width} AND py >= 0 AND py < {CAMERA.height} GROUP BY ALL),
img AS (SELECT px, py, m.depth depth, m.rgba rgba FROM pix)"""


def moved() -> str:
    return "mv AS (SELECT x - xmin x, y - ymin y, z - zmin z, rgba FROM p, b)"


def lod_samples(view: str) -> str:
    bits = 1 << TREES[view].grid_bits
    centre = ", ".join(f"({a}min + {gather('v.node', k)} * (size / pow(2, v.level)) + (size / pow(2, v.level)) * ((v.i{a} + 0.5e0) / {num(bits)})) - {a}min {a}" for k, a in enumerate("xyz"))
    return f"""{visible(view)},
smp AS (SELECT k.x - xmin x, k.y - ymin y, k.z - zmin z, k.rgba FROM b, k JOIN front f ON NOT f.is_inner AND k.code >> (3 * (20 - f.level)) = f.code
 UNION ALL SELECT {centre}, v.rgba FROM b, vox v JOIN front f ON f.is_inner AND f.level = v.level AND f.code = v.node)"""


EDL = f"""nbr AS (SELECT px + ox px, py + oy py, depth near FROM img, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(ox, oy)),
edl AS (SELECT px, py, depth, exp(coalesce(avg(greatest(0, log2(depth) - log2(near))), 0) * {num(-24.0 * 0.4)}) shade FROM img LEFT JOIN nbr USING (px, py) GROUP BY px, py, depth, rgba)"""
