import struct

import pytest

from octolith.config import Camera
from octolith.functions import colour
from octolith.operators import raster
from octolith.sources import files, synthetic

ROWS = [(k, k * 0.5, -k * 0.25, k * 2.0, 0xFF000000 | k * 65793 % 0x1000000) for k in range(100)]


def las(points=ROWS, form=2, record=26, offset=227, scale=(0.25, 0.25, 0.5), signature=b"LASF", minor=2, count=None, cut=0, header=227):
    head = bytearray(max(header, 227))
    head[:4] = signature
    head[24:26] = bytes([1, minor])
    struct.pack_into("<HI", head, 94, header, offset)
    struct.pack_into("<BHI", head, 104, form, record, len(points) if count is None else count)
    struct.pack_into("<3d3d", head, 131, *scale, 0.0, 0.0, 0.0)
    body = b"".join(struct.pack("<3i", *(round(v / s) if s else 0 for v, s in zip(p[1:4], scale))) + bytes(8) + struct.pack("<3H", *((p[4] >> s & 255) << 8 for s in (0, 8, 16))) + bytes(record - 26) for p in points)
    out = bytes(head) + bytes(max(0, offset - len(head))) + body
    return out[: len(out) - cut] if cut else out


def test_raw_and_las_hold_the_same_cloud(spark, tmp_path):
    df = spark.createDataFrame(ROWS, files.SCHEMA)
    files.write_raw(df, str(tmp_path / "a.bin"))
    (tmp_path / "a.LAS").write_bytes(las())
    raw = files.load_cloud(spark, str(tmp_path / "a.bin"), split_points=7)
    from_las = files.load_cloud(spark, str(tmp_path / "a.LAS"), split_points=33)
    assert raw.exceptAll(df).isEmpty() and df.exceptAll(raw).isEmpty()
    mask = 0xFFFFFFFF
    assert sorted((r.seq, r.x, r.y, r.z, r.rgba & mask) for r in from_las.collect()) == [(s, x, y, z, c & mask) for s, x, y, z, c in ROWS]
    assert files.load_clouds(spark, f"{tmp_path}/*").groupBy("file").count().count() == 2


@pytest.mark.parametrize("change,message", [
    ({"signature": b"LASX"}, "not a LAS"), ({"form": 11}, "unknown point format"), ({"form": 3}, "too short"), ({"scale": (0.0, 1, 1)}, "scale factor"),
    ({"cut": 30}, "cut short"), ({"form": 0x82}, "decoder"), ({"offset": 200}, "inside the header"),
])
def test_las_faults(tmp_path, change, message):
    path = tmp_path / "b.las"
    path.write_bytes(las(**change))
    with pytest.raises(ValueError, match=message):
        files.read_header(str(path))


@pytest.mark.parametrize("size,message", [(10, "smaller"), (24, "no points"), (30, "whole points")])
def test_raw_faults(size, message):
    with pytest.raises(ValueError, match=message):
        files.raw_header(size)


def test_listing_puts_supported_files_first(spark, tmp_path):
    (tmp_path / "z.las").write_bytes(las())
    (tmp_path / "a.laz").write_bytes(las())
    got = files.datasets(spark, str(tmp_path)).collect()
    assert [(r.label, r.supported, r.points) for r in got] == [("z.las", True, 100), ("a.laz", False, None)]


def test_one_file_at_a_time(spark, tmp_path):
    with pytest.raises(ValueError):
        files.load_cloud(spark, ["a", "b"])
    with pytest.raises(FileNotFoundError):
        files.load_cloud(spark, str(tmp_path / "none.las"))


def test_files_of_other_names_need_a_kind(spark, tmp_path):
    df = spark.createDataFrame(ROWS, files.SCHEMA)
    files.write_raw(df, str(tmp_path / "cloud.dat"))
    with pytest.raises(ValueError, match="unknown kind"):
        files.load_cloud(spark, str(tmp_path / "cloud.dat"))
    assert files.load_cloud(spark, str(tmp_path / "cloud.dat"), kind="raw").count() == 100
    assert files.load_cloud(spark, f"file://{tmp_path}/cloud.dat", kind="raw", split_points=9).agg({"seq": "sum"}).first()[0] == 4950


@pytest.mark.parametrize("claimed,low,again", [((0.0, 49.5), 0.0, False), ((5.0, 60.0), 0.0, True), ((0.1, 10.0), 0.1, False), ((-3.0, 49.5), -3.0, False)])
def test_header_bounds_are_corrected_by_the_points(spark, claimed, low, again):
    from dataclasses import replace

    from octolith.operators import cloud

    seen = cloud.Box.of(spark.createDataFrame(ROWS, files.SCHEMA))
    header = files.las_header(las(scale=(0.25, 0.25, 0.5)), 10_000)
    header = replace(header, low=(claimed[0], *seen.low[1:]), high=(claimed[1], *seen.high[1:]))
    box, moved = cloud.header_box(header, seen)
    assert (box.low[0], box.high[0], moved) == (low, max(claimed[1], 49.5), again)
    assert cloud.header_box(files.raw_header(40), seen) == (seen, False)


def test_synthetic_cloud_is_a_shell_and_a_helix(spark):
    a, b = synthetic.cloud(spark, 800), synthetic.cloud(spark, 800).repartition(5)
    assert a.exceptAll(b).isEmpty()
    shell = a.where("seq < 700")
    assert shell.where("least(x, y, z, 100 - x, 100 - y, 100 - z) > 2.0001").isEmpty()
    assert a.where(f"rgba = {synthetic.HELIX_COLOUR}").count() == 100


def test_image_file(spark, tmp_path):
    camera = Camera.orbit((1.0, 1.0, 1.0), 8, 4)
    image = raster.resolved(spark.createDataFrame([(1, 0, 1.0, 0xFF0000FF)], "px long, py long, depth double, rgba long"), camera)
    files.write_ppm(image, 8, 4, str(tmp_path / "i.ppm"))
    data = (tmp_path / "i.ppm").read_bytes()
    assert data[:11] == b"P6\n8 4\n255\n" and len(data) == 11 + 96
    assert data[11 + 3 * (3 * 8 + 1) :][:3] == b"\xff\0\0"
    assert data[11:14] == bytes([colour.CLEAR & 255, colour.CLEAR >> 8 & 255, colour.CLEAR >> 16 & 255])


def test_a_file_as_a_stream(spark, tmp_path):
    (tmp_path / "c.las").write_bytes(las())
    spark.dataSource.register(files.PointFileSource)
    stream = spark.readStream.format("points").option("batch_points", 30).option("split_points", 13).load(str(tmp_path / "c.las"))
    sizes = []
    query = stream.writeStream.foreachBatch(lambda df, k: sizes.append(df.count())).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert [n for n in sizes if n] == [30, 30, 30, 10]


def test_command_line(spark, tmp_path, capsys):
    from octolith.__main__ import main

    (tmp_path / "d.las").write_bytes(las())
    assert main(["--list-datasets", str(tmp_path)]) == 0
    assert main(["--synthetic", "300", "--threshold", "40", "--size", "32x18", "--lod-budget", "8", "--dump-frame", str(tmp_path / "f.ppm"), "--free-memory", "12G", "--record", str(tmp_path / "r")]) == 0
    assert {r.name for r in spark.read.json(str(tmp_path / "r")).collect()} >= {"points", "nodes", "required_bytes"}
    assert (tmp_path / "f.ppm").read_bytes().startswith(b"P6\n32 18\n255\n")
    assert "inner_nodes" in capsys.readouterr().out


def test_queries_that_cannot_be_planned_are_named(spark):
    from octolith.operators import budget
    from octolith.plans import report

    queries = {"good": lambda spark, _: spark.range(3), "bad": lambda spark, _: spark.range(3).select("nothing")}
    assert [n for n, _ in report.check_queries(spark, "", queries)] == ["bad"]
    assert budget.usable_budget(2 << 30) == int((1536 << 20) * 0.85) and budget.usable_budget(2 << 30, 7) == 7 and budget.usable_budget(5) == 0
