"""Binary point files as Spark data sources, split by byte ranges: LAS, and raw 16-byte points."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from octolith.config import BATCH_POINTS

SCHEMA = "seq long, x double, y double, z double, rgba long"
SPLIT_POINTS = 4_000_000
_BATCH = 65_536
LAS_NAMES, RAW_NAMES = ("las", "laz"), ("bin", "raw", "pts16")
_RAW_HEADER = 24
_RAW = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("rgba", "<u4")])
#: LAS point formats 0-10 as the public specification has them: least record length, offset of the colours (0: none).
LAS_FORMATS = {0: (20, 0), 1: (28, 0), 2: (26, 20), 3: (34, 28), 4: (57, 0), 5: (63, 28), 6: (30, 0), 7: (36, 30), 8: (38, 30), 9: (59, 0), 10: (67, 30)}


@dataclass(frozen=True)
class Header:
    kind: str
    points: int
    offset: int
    record: int
    scale: tuple[float, float, float] = (1.0, 1.0, 1.0)
    shift: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low: tuple[float, float, float] | None = None
    high: tuple[float, float, float] | None = None
    colours: int = 0


def raw_header(size: int, path: str = "") -> Header:
    if size < _RAW_HEADER:
        raise ValueError(f"file is smaller than its header: {path}")
    if (size - _RAW_HEADER) % _RAW.itemsize:
        raise ValueError(f"file does not hold whole points: {path}")
    if size == _RAW_HEADER:
        raise ValueError(f"file holds no points: {path}")
    return Header("raw", (size - _RAW_HEADER) // _RAW.itemsize, _RAW_HEADER, _RAW.itemsize)


def las_header(head: bytes, size: int, path: str = "") -> Header:
    """Checks and reads a LAS public header; ``size`` is that of the file."""
    if size < 227 or len(head) < 227:
        raise ValueError(f"file is smaller than a LAS header: {path}")
    if head[:4] != b"LASF":
        raise ValueError(f"not a LAS file: {path}")
    (length, offset), (raw_format, record, points) = struct.unpack_from("<HI", head, 94), struct.unpack_from("<BHI", head, 104)
    if raw_format & 0xC0 or path.lower().endswith(".laz"):
        raise ValueError(f"compressed points need a decoder that is not installed: {path}")
    form = raw_format & 0x3F
    if form not in LAS_FORMATS:
        raise ValueError(f"unknown point format {form}: {path}")
    least, colours = LAS_FORMATS[form]
    if record < least:
        raise ValueError(f"records of {record} bytes are too short for point format {form}: {path}")
    if offset < length:
        raise ValueError(f"points begin inside the header: {path}")
    if head[24] == 1 and head[25] >= 4 and len(head) >= 255:
        points = struct.unpack_from("<Q", head, 247)[0] or points
    scale, shift = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
    if 0.0 in scale:
        raise ValueError(f"a scale factor is zero: {path}")
    if offset + points * record > size:
        raise ValueError(f"file is cut short: {path}")
    box = struct.unpack_from("<6d", head, 179)
    return Header("las", points, offset, record, scale, shift, box[1::2], box[::2], colours)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path there: a local one, or any that its address names (s3, gs, hdfs, file)."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def header_of(head: bytes, size: int, path: str, kind: str | None = None) -> Header:
    """A file is LAS if it is signed so or named ``.las`` or ``.laz`` in any case, raw if it is named so (``RAW_NAMES``); any other has to be called ``raw`` or ``las`` by ``kind``."""
    name = path.lower().rpartition(".")[2]
    if kind == "las" or kind is None and (head[:4] == b"LASF" or name in LAS_NAMES):
        return las_header(head, size, path)
    if kind == "raw" or kind is None and name in RAW_NAMES:
        return raw_header(size, path)
    raise ValueError(f"unknown kind of file: {path}")


def read_header(path: str, kind: str | None = None) -> Header:
    store, there = _store(path)
    with store.open_input_file(there) as f:
        return header_of(f.read(375), f.size(), path, kind)


def decode(header: Header, data: bytes, first: int) -> pa.RecordBatch:
    """Points of whole records; ``first`` numbers the first one."""
    n = len(data) // header.record
    if header.kind == "raw":
        points = np.frombuffer(data, _RAW, n)
        xyz, rgba = [points[a].astype(np.float64) for a in "xyz"], points["rgba"].astype(np.int64)
    else:
        rows = np.frombuffer(data, np.uint8, n * header.record).reshape(n, header.record)
        ints = np.ascontiguousarray(rows[:, :12]).view("<i4")
        xyz = [ints[:, k] * header.scale[k] + header.shift[k] for k in range(3)]
        if header.colours:
            c = np.ascontiguousarray(rows[:, header.colours : header.colours + 6]).view("<u2").astype(np.int64)
            c = np.where(c > 255, c >> 8, c)
            rgba = c[:, 0] | c[:, 1] << 8 | c[:, 2] << 16 | 255 << 24
        else:
            rgba = np.full(n, 0xFFFFFFFF, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(first + np.arange(n)), *map(pa.array, xyz), pa.array(rgba)], ["seq", "x", "y", "z", "rgba"])


@dataclass
class _Range(InputPartition):
    first: int
    count: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int, kind: str | None = None):
        self.path, self.split, self.header = path, split, read_header(path, kind)

    def partitions(self) -> list[InputPartition]:
        return [_Range(k, min(self.split, self.header.points - k)) for k in range(0, self.header.points, self.split)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        h, left, at = self.header, partition.count, partition.first
        store, there = _store(self.path)
        with store.open_input_file(there) as f:
            f.seek(h.offset + at * h.record)
            while left:
                n = min(left, _BATCH)
                yield decode(h, f.read(n * h.record), at)
                at, left = at + n, left - n


class _StreamReader(DataSourceStreamReader):
    """A file as a finite stream: each micro-batch takes the next ``batch_points`` points; offsets are points, so a restart goes on where the last commit was."""

    def __init__(self, path: str, batch_points: int, split: int, kind: str | None = None):
        self.inner, self.batch, self.seen = _Reader(path, split, kind), batch_points, 0

    def initialOffset(self) -> dict:
        return {"point": 0}

    def latestOffset(self) -> dict:
        self.seen = min(self.seen + self.batch, self.inner.header.points)
        return {"point": self.seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = max(self.seen, end["point"])
        return [_Range(k, min(self.inner.split, end["point"] - k)) for k in range(start["point"], end["point"], self.inner.split)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return self.inner.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to free: the file stays."""


class PointFileSource(DataSource):
    """``spark.read.format("points").load(path)``: seekable ranges of one file, on a path that all executors share or in a store that its address names. ``kind`` (``las``, ``raw``) says what a file of another name is."""

    @classmethod
    def name(cls) -> str:
        return "points"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if not (path := self.options.get("path")):
            raise ValueError("a point file needs a path")
        return _Reader(path, int(self.options.get("split_points", SPLIT_POINTS)), self.options.get("kind"))

    def streamReader(self, schema) -> DataSourceStreamReader:
        if not (path := self.options.get("path")):
            raise ValueError("a point file needs a path")
        return _StreamReader(path, int(self.options.get("batch_points", BATCH_POINTS)), int(self.options.get("split_points", SPLIT_POINTS)), self.options.get("kind"))


def load_cloud(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """The points of one file, in file order by ``seq``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if len(paths) != 1:
        raise ValueError("one file at a time")
    read_header(paths[0], options.get("kind"))
    spark.dataSource.register(PointFileSource)
    return spark.read.format("points").options(**options).load(paths[0])


def load_clouds(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The points of many smaller files on any file system that Spark reads, one task and at most 2 GB a file: ``file`` and the point columns. Large files go through ``load_cloud``, which splits them."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_py()
                header = header_of(data[:375], len(data), path, kind)
                for at in range(0, header.points, _BATCH):
                    n = min(_BATCH, header.points - at)
                    out = decode(header, data[header.offset + at * header.record : header.offset + (at + n) * header.record], at)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), *out.columns], ["file", *out.schema.names])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, " + SCHEMA)


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder: ``path, label, bytes, points, supported, note``, supported ones first, then by label. Only headers are read."""
    rows, (store, there) = [], _store(folder)
    scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
    for info in store.get_file_info(pafs.FileSelector(there, recursive=True)):
        if info.is_file and info.base_name.lower().rpartition(".")[2] in LAS_NAMES + RAW_NAMES:
            path = scheme + info.path
            try:
                rows.append((path, info.base_name, info.size, read_header(path).points, True, ""))
            except ValueError as e:
                rows.append((path, info.base_name, info.size, None, False, str(e).rpartition(": ")[0]))
    df = spark.createDataFrame(rows, "path string, label string, bytes long, points long, supported boolean, note string")
    return df.orderBy(F.desc("supported"), "label")


def write_raw(points: DataFrame, path: str) -> None:
    """One raw file in ``seq`` order; partitions come to the driver one after the other."""
    box = points.agg(*[f(a) for f in (F.min, F.max) for a in "xyz"]).first()
    with open(path, "wb") as f:
        f.write(struct.pack("<6f", *box))
        for r in points.orderBy("seq").select("x", "y", "z", "rgba").toLocalIterator():
            f.write(struct.pack("<3fI", *r))


def write_ppm(image: DataFrame, width: int, height: int, path: str) -> None:
    """A binary PPM of resolved pixels, the top row first; the image's size bounds what the driver gets."""
    out = np.zeros((height, width, 3), np.uint8)
    for px, py, rgba in image.select("px", "py", "rgba").toLocalIterator():
        out[height - 1 - py, px] = rgba & 255, rgba >> 8 & 255, rgba >> 16 & 255
    with open(path, "wb") as f:
        f.write(b"P6\n%d %d\n255\n" % (width, height) + out.tobytes())
