import pytest

from octolith import settings
from octolith.config import TreeParams
from octolith.operators import budget, cloud
from octolith.operators.tree import Tree
from octolith.plans import pipelines
from octolith.sources import views
from octolith.streaming import batches

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("files_per_batch,parts", [(1, 6), (3, 6), (9, 2)])
def test_stream_gives_the_tree_of_the_batch(spark, tmp_path, files_per_batch, parts):
    points = views.events(spark, SF)
    box = cloud.bounds(points).first()
    points.repartition(parts, "seq").write.parquet(str(tmp_path / "in"))
    state = batches.CellState(str(tmp_path / "state"), 8, (box["xmin"], box["ymin"], box["zmin"], box["size"]))
    schema = "seq long, x double, y double, z double, rgba long"
    for _ in range(2):  # run again: nothing is counted twice
        batches.run_stream(spark, str(tmp_path / "in"), schema, state, str(tmp_path / "checkpoint"), files_per_batch)
    tree = Tree.adaptive(cloud.keyed(points), settings.TREES["events"])
    want = {(r.level, r.code) for r in tree.inner.collect()}
    assert {(r.level, r.code) for r in state.inner(spark, 200).collect()} == want
    small = state.compact(spark, str(tmp_path / "compact"))
    assert {(r.level, r.code) for r in small.inner(spark, 200).collect()} == want


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    points = views.events(spark, SF)
    box = cloud.bounds(points).first()
    state = batches.CellState(str(tmp_path / "s"), 4, (box["xmin"], box["ymin"], box["zmin"], box["size"]))
    for _ in range(2):
        state.fold(points, 0)
    assert state.cells(spark).groupBy().sum("n").first()[0] == 1000


@pytest.mark.parametrize("size", [50, 1000, 100_000])
def test_last_progressive_tree_is_the_whole_one(spark, size):
    keyed = cloud.keyed(views.events(spark, SF))
    rows = batches.progressive(keyed, settings.TREES["events"], size, 8).orderBy("batch").collect()
    assert [r.inner_nodes for r in rows] == sorted(r.inner_nodes for r in rows)
    assert (rows[-1].inner_nodes, rows[-1].points, rows[-1].nodes) == (7, 1000, 57)


def test_ring():
    assert [batches.slot(b, 5) for b in (0, 4, 5, 12)] == [0, 4, 0, 2]
    assert batches.may_produce(4, 0, 5) and not batches.may_produce(5, 0, 5)
    with pytest.raises(ValueError):
        batches.may_produce(1, 2)


@pytest.mark.parametrize("gb,percent", [(6.00, 48.4), (7.05, 60.2), (7.07, 60.3), (11.0, 100.0)])
def test_predicted_completion(spark, gb, percent):
    df = spark.createDataFrame([("p", 350_360_028, int(gb * 1e9), False)], "pipeline string, points long, budget long, resident boolean")
    assert budget.admission(df).first()["completion"] * 100 == pytest.approx(percent, abs=0.3)


@pytest.mark.parametrize("text,bytes_", [("9G", 9_000_000_000), ("8Gi", 8 << 30), ("512M", 512_000_000), ("100", 100), ("1.5k", 1500), ("2 GB", 2_000_000_000)])
def test_sizes(text, bytes_):
    assert budget.parse_bytes(text) == bytes_


@pytest.mark.parametrize("text", ["", "G", "5X", "-1G", "5i", "5GGi"])
def test_no_sizes(text):
    with pytest.raises(ValueError):
        budget.parse_bytes(text)


def test_registry(spark):
    r = pipelines.standard(settings.TREES["events"], 3)
    assert r.names() == ["adaptive", "fixed_depth", "flat"]
    with pytest.raises(ValueError):
        r.add(pipelines.Flat())
    with pytest.raises(KeyError):
        r.find("other")
    points = views.events(spark, SF)
    for name in r.names():
        p = r.find(name)
        assert p.select(p.build(points), settings.CAMERA, settings.PIXELS).count() >= 0
    with pytest.raises(ValueError):
        pipelines.FixedDepth(depth=9)


def test_trees_of_batches_go_as_deep_as_the_whole_one(spark, tmp_path, monkeypatch):
    from octolith import queries

    points = spark.range(900).selectExpr("id * 7 seq", "if(id % 3 = 0, 5.0, id * 0.9) x", "if(id % 3 = 0, 5.0, id * 0.5) y", "if(id % 3 = 0, 5.0, 900.0 - id) z", "0L rgba")
    points.write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    monkeypatch.setattr(views, "events", lambda spark, sf_dir: points)
    tree = Tree.adaptive(cloud.keyed(points), settings.TREES["events"])
    want = {(r.level, r.code, r.n) for r in tree.cells.join(tree.inner, ["level", "code"]).collect()}
    assert max(level for level, _, _ in want) == 19
    assert {(r.level, r.code, r.n) for r in queries.stream_equals_batch(spark, "").collect()} == want
    last = queries.progressive_octree(spark, "").orderBy("batch").collect()[-1]
    assert (last.points, last.inner_nodes) == (900, len(want))
    assert queries.batch_ratios(spark, "").first().splits == len(want)


def test_sums_carried_by_a_stream_are_those_of_one_build(spark, tmp_path):
    import random

    from octolith.operators import accum

    r = random.Random(5)
    rows = [(k, r.random(), r.random(), r.random() / 2, r.randrange(1 << 32)) for k in range(300)] + [(300 + k, 0.7, 0.2, 0.1, 5) for k in range(20)] + [(400, 0.0, 0.0, 0.0, 1), (401, 1.0, 1.0, 1.0, 2), (402, 1.0, 0.5, 0.2, 3)]
    points = spark.createDataFrame(rows, "seq long, x double, y double, z double, rgba long")
    state = batches.SumState(str(tmp_path / "s"), 12, (0.0, 0.0, 0.0, 1.0), 100)
    for k in range(3):
        state.fold(points.where(f"seq % 3 = {k}"), k)
    state.fold(points.where("seq % 3 = 1"), 1)  # run again
    for own in (state, state.compact(spark, str(tmp_path / "c"))):
        got = {(x.level, x.leaf): x for x in own.leaf_sums(spark, 15).collect()}
        tree = Tree.adaptive(cloud.keyed(points), TreeParams(15, 12)).settle()
        want = {(x.level, x.leaf): x for x in accum.leaf_sums(tree, 100).collect()}
        assert got.keys() == want.keys()
        for k, w in want.items():
            assert (got[k].n, got[k].last_batch) == (w.n, w.last_batch)
            assert all(got[k][c] == pytest.approx(w[c], abs=1e-9) for c in accum.SUMS)
