"""Command line: list files, open or generate a cloud, print its report, write an image."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from octolith.config import Camera, TreeParams
from octolith.operators import budget
from octolith.plans import pipelines, render, report
from octolith.sources import files, synthetic


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="octolith", description=__doc__)
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--open", metavar="FILE")
    source.add_argument("--synthetic", type=int, metavar="POINTS")
    source.add_argument("--list-datasets", metavar="FOLDER")
    source.add_argument("--check", metavar="FOLDER", help="plan every registered query over the tables there")
    p.add_argument("--pipeline", default="adaptive")
    p.add_argument("--fixed-depth", type=int, default=7, metavar="1..8")
    p.add_argument("--threshold", type=int, default=TreeParams().threshold)
    p.add_argument("--size", default="1600x900")
    p.add_argument("--dump-frame", metavar="PPM")
    p.add_argument("--lod-budget", type=float, default=128.0)
    p.add_argument("--show-boxes", action="store_true")
    p.add_argument("--hide-points", action="store_true")
    p.add_argument("--budget", help="bytes, such as 9G or 8Gi; 11G if neither this nor --free-memory is given")
    p.add_argument("--free-memory", metavar="BYTES", help="what is free: the budget is 85 % of it beyond 512 MiB, unless --budget pins one")
    p.add_argument("--record", metavar="FOLDER", help="append the report there as JSON lines")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    if a.list_datasets:
        found = files.datasets(spark, a.list_datasets)
        found.show(1000, False)
        return int(found.isEmpty())
    if a.check:
        from octolith.queries import QUERIES

        failed = report.check_queries(spark, a.check, QUERIES)
        for name, why in failed:
            print(name, why, file=sys.stderr)
        return int(bool(failed))
    points = files.load_cloud(spark, a.open) if a.open else synthetic.cloud(spark, a.synthetic)
    pipeline = pipelines.standard(TreeParams(a.threshold), a.fixed_depth).find(a.pipeline)
    built = pipeline.build(points)
    if not isinstance(built, pipelines.Built):
        pipeline.select(built, None, a.lod_budget).show()
        return 0
    if a.free_memory:
        allowed = budget.usable_budget(budget.parse_bytes(a.free_memory), budget.parse_bytes(a.budget or "0"))
    else:
        allowed = budget.parse_bytes(a.budget or "11G")
    made = report.build_report(built, allowed)
    made.show(100, False)
    if a.record:
        report.write_records(made, a.record)
    if a.dump_frame:
        width, height = map(int, a.size.lower().split("x"))
        camera = Camera.orbit(built.box.extent, width, height)
        options = render.Options(a.lod_budget, show_boxes=a.show_boxes, show_points=not a.hide_points)
        files.write_ppm(render.frame(built, camera, options), width, height, a.dump_frame)
    return 0


if __name__ == "__main__":
    sys.exit(main())
