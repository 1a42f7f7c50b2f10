import pytest
from pyspark.sql import functions as F

from poseweave.functions.grid import fixed_grid, with_grid
from poseweave.operators import gridmap as G

GRID = "run bigint, nx bigint, ny bigint, min_x double, min_y double, dx double, dy double"


def grid(spark, nx, ny, low, high):
    return spark.createDataFrame([(0, nx, ny, *low, (high[0] - low[0]) / (nx - 1), (high[1] - low[1]) / (ny - 1))], GRID)


def ramp(spark):
    g = grid(spark, 3, 3, (0.0, 0.0), (2.0, 2.0))
    return g, G.grid_nodes(g, ["run"]).withColumn("value", F.col("w") + 10.0 * F.col("h"))


def test_lookup_edges_and_values(spark):
    g, nodes = ramp(spark)
    points = spark.createDataFrame([(0, n, *p) for n, p in enumerate(
        [(.5, .25), (1., 1.), (2., 2.), (-.1, 1.), (1., 2.1), (float("nan"), 1.)])], "run bigint, k bigint, gx double, gy double")
    cells = {r.k: r for r in G.attach_cells(points.join(g, "run")).collect()}
    assert [cells[k].inside for k in range(6)] == [True, True, True, False, False, False]
    assert (cells[1].cw, cells[1].ch, cells[1].alpha, cells[1].beta) == (1, 1, 0.0, 0.0)
    assert (cells[2].cw, cells[2].ch, cells[2].alpha, cells[2].beta) == (1, 1, 1.0, 1.0)
    found = {r.k: r for r in G.sample(points, nodes, g, ["run"]).collect()}
    assert sorted(found) == [0, 1, 2]
    assert found[0].sdf == pytest.approx(.5 * .75 * 1 + .5 * .25 * 10 + .5 * .25 * 11)
    assert (found[0].exact_gx, found[0].exact_gy) == pytest.approx((1.0, 10.0))
    assert (found[0].smooth_gx, found[0].smooth_gy) == pytest.approx((1.0, 10.0))
    probe = G.probe_gradient(points.where("k = 0"), nodes, g, ["run"], ["k"], 0.3).first()
    assert (probe.probe_gx, probe.probe_gy) == pytest.approx((1.0, 10.0))


def test_clamped_lookup_extrapolates(spark):
    g = fixed_grid(3, 3, (0.0, 0.0), (2.0, 2.0))
    df = with_grid(spark.createDataFrame([(-.5, 2.5)], "gx double, gy double"), g)
    row = G.attach_cells(df).first()
    assert (row.cw, row.ch, row.alpha, row.beta) == (0, 1, -.5, 1.5)
    with pytest.raises(ValueError):
        fixed_grid(1, 3, (0.0, 0.0), (2.0, 2.0))


def test_upsample_size_and_values(spark):
    g, nodes = ramp(spark)
    rows = {(r.row, r.col): r.value for r in G.upsample(nodes, g, ["run"], 4).collect()}
    assert len(rows) == 81 and rows[8, 8] == 22.0
    assert rows[1, 2] == pytest.approx(.5 + 2.5)


def test_hallucinated_points(spark):
    beam = spark.createDataFrame([(0, 4.0, 0.0), (1, 0.0, 0.0)], "idx bigint, sx double, sy double")
    rows = G.hallucinate(beam, 6, 0.1, True).orderBy("j", F.desc("side")).collect()
    assert [(round(r.sx, 9), round(r.delta, 9)) for r in rows] == [
        (3.9, .1), (4.1, -.1), (3.8, .2), (4.2, -.2), (3.7, .3), (4.3, -.3)]
    assert G.hallucinate(beam, 5, 0.1, True).count() == 4
    assert G.hallucinate(beam, 1, 0.1, True).count() == 0
    one_way = G.hallucinate(spark.createDataFrame([(0.0, 2.0)], "sx double, sy double"), 3, 0.5, False).collect()
    assert len(one_way) == 3 and all(r.delta > 0 and r.sy < 2 for r in one_way)


def wall_map(spark, pose=(0.0, 0.0, 0.0), signed=True):
    g = grid(spark, 11, 11, (0.0, -2.0), (4.0, 2.0))
    rows = [(0, 0, i, 2.0 + pose[0] * 0, 0.1 * (i - 20), *pose) for i in range(41)]
    points = spark.createDataFrame(rows, "run bigint, frame bigint, idx bigint, sx double, sy double, x double, y double, theta double")
    points = points.withColumns({"gx": F.col("sx") + F.col("x"), "gy": F.col("sy") + F.col("y")})
    blank = G.grid_nodes(g, ["run"], 0.25)
    tree = G.surface_tree(points, ["run"], ["frame", "idx"])
    owners = G.node_owners(blank, tree, ["run"], ["frame", "idx"])
    return {(r.w, r.h): r.value for r in G.init_from_scans(blank, owners, ["run"], signed).collect()}, blank, points


def test_map_from_wall(spark):
    values, blank, points = wall_map(spark)
    assert (values[5, 5], values[3, 5], values[7, 5]) == pytest.approx((0.0, 0.8, -0.8), abs=1e-9)
    unsigned, _, _ = wall_map(spark, signed=False)
    assert unsigned[7, 5] == pytest.approx(0.8)
    moved, _, _ = wall_map(spark, (1.0, 0.0, 0.0))
    assert (moved[7, 5], moved[9, 5]) == pytest.approx((0.2, -0.6))


def test_out_of_domain_share(spark):
    g, _ = ramp(spark)
    points = spark.createDataFrame([(0, 1.0, 1.0), (0, 3.0, 1.0)], "run bigint, gx double, gy double")
    row = G.outside_share(points, g, ["run"]).first()
    assert (row.outside, row.total, row.percent) == (1, 2, 50.0)
