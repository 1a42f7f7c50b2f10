import numpy as np
import pytest
from pyspark.sql import functions as F

from poseweave.operators.neighbors import build_tree, nearest
from poseweave.operators.normals import scan_normals
from poseweave.session import pin


def frame(spark, groups):
    rows = [(g, i, float(x), float(y)) for g, pts in enumerate(groups) for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "run bigint, idx bigint, x double, y double")


def brute(points, queries, k):
    d = ((queries[:, None] - points[None]) ** 2).sum(2)
    return [sorted(range(len(points)), key=lambda i: (row[i], i))[:k] for row in d]


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(4)
    mixed = np.vstack([rng.normal(size=(150, 2)), rng.normal(scale=1e-4, size=(120, 2)) + 50,  # a dense spot far away
                       np.repeat([[3.0, 3.0]], 90, axis=0),  # a third of the points are copies
                       [[1e4, 1e4]]])
    return [mixed, rng.uniform(size=(3, 2)), np.repeat([[1.0, 2.0]], 40, axis=0)]


def test_self_join_is_exact_under_copies_and_dense_spots(spark, clouds):
    points = frame(spark, clouds)
    tree = build_tree(points, ["run"], ["idx"], copies=5)
    assert not tree.whole
    found = nearest(points, ["idx"], tree, 5, ["idx"], ["idx"]).toPandas()
    for g, cloud in enumerate(clouds):
        want = brute(cloud, cloud, 5)
        mine = found[found.run == g].sort_values(["idx", "rank"]).groupby("idx").n_idx.apply(list)
        assert mine.tolist() == want


def test_foreign_queries_alone_in_tiles_and_within(spark, clouds):
    rng = np.random.default_rng(6)
    asked = rng.uniform(-60, 120, size=(80, 2))
    queries = frame(spark, [asked]).withColumnRenamed("idx", "q")
    tree = build_tree(frame(spark, clouds[:1]), ["run"], ["idx"], copies=3)
    want = brute(clouds[0], asked, 3)
    tile = {"_a": F.floor(F.col("x") / 40), "_b": F.floor(F.col("y") / 40)}
    for options in ({"block_rows": None}, {"block_rows": 8}, {"tile": tile}):
        found = nearest(queries, ["q"], tree, 3, ["idx"], ["idx"], **options).toPandas()
        assert found.sort_values(["q", "rank"]).groupby("q").n_idx.apply(list).tolist() == want
    close = nearest(queries, ["q"], tree, 1, ["idx"], ["idx"], within=20.0, block_rows=None).toPandas()
    d = np.sqrt(((asked[:, None] - clouds[0][None]) ** 2).sum(2)).min(1)
    assert sorted(close.q) == sorted(np.flatnonzero(d < 20.0).tolist())
    with pytest.raises(ValueError):
        nearest(queries, ["q"], tree, 4, ["idx"], ["idx"])


def world(spark, points):
    rows = [(0, 0, i, float(x), float(y)) for i, (x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "run bigint, frame bigint, idx bigint, sx double, sy double")
    return df.withColumns({"x": F.lit(0.0), "y": F.lit(0.0), "theta": F.lit(0.0), "gx": F.col("sx"), "gy": F.col("sy")})


@pytest.mark.parametrize("per_scan", [False, True])
def test_wall_normals_face_the_sensor(spark, per_scan):
    rows = scan_normals(world(spark, [(0.2 * i, 5.0) for i in range(-20, 21)]), 8, per_scan).collect()
    assert len(rows) == 41
    assert all(abs(r.normal_x) < 1e-6 and abs(r.normal_y + 1) < 1e-6 and r.cornerness < 1e-6 for r in rows)


def test_corner_is_seen(spark):
    walls = [(5.0, 0.2 * i) for i in range(26)] + [(0.2 * i, 5.0) for i in range(25)]
    rows = scan_normals(world(spark, walls), 10).collect()
    best = max(rows, key=lambda r: r.cornerness)
    assert best.cornerness > 0.1 and abs(best.gx - 5) + abs(best.gy - 5) < 1.0


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_whole_groups_and_cells_side_by_side(spark, clouds, small_batches):
    rng = np.random.default_rng(9)
    groups = [clouds[0], *[rng.integers(0, 4, size=(n, 2)).astype(float) for n in (1, 2, 5, 30)]]
    asked = [rng.uniform(-5, 6, size=(20, 2))] * len(groups)
    points, queries = frame(spark, groups), frame(spark, asked).withColumnRenamed("idx", "q")
    tree = build_tree(points, ["run"], ["idx"], copies=3, packed_points=100)
    assert tree.large.count() == 1 and not tree.whole
    found = nearest(queries, ["q"], tree, 3, ["idx"], ["idx"]).toPandas().sort_values(["run", "q", "rank"])
    for g, cloud in enumerate(groups):
        assert found[found.run == g].groupby("q").n_idx.apply(list).tolist() == brute(cloud, asked[g], 3)


def test_whole_groups_over_many_batches(spark, small_batches):
    rng = np.random.default_rng(2)
    groups = [rng.integers(0, 4, size=(n, 2)).astype(float) for n in (40, 1, 3, 25)]
    tree = build_tree(frame(spark, groups), ["run"], ["idx"], copies=4, packed_points=100)
    found = nearest(tree, ["idx"], tree, 4, ["idx"], ["idx"]).toPandas().sort_values(["run", "idx", "rank"])
    for g, cloud in enumerate(groups):
        assert found[found.run == g].groupby("idx").n_idx.apply(list).tolist() == brute(cloud, cloud, 4)
    near = nearest(tree, ["idx"], tree, 4, ["idx"], ["idx"], within=1.0).toPandas()
    assert (near.d2 == 0).all() and set(near[near.run == 1].n_idx) == {0}


def test_exploded_nodes_are_never_broadcast(spark, capsys):
    from poseweave.operators import gridmap as G

    points = frame(spark, [[(0.1 * i, 0.2 * i) for i in range(50)]])
    # A written table has a known size, that of its few rows before they are exploded.
    grids = spark.createDataFrame([(0, 21, 17, 0.0, 0.0, 1.0, 1.0)],
                                  "run bigint, nx bigint, ny bigint, min_x double, min_y double, dx double, dy double")
    grids = pin(grids, "grids")
    tile = {"_tw": F.floor(F.col("w") / 3), "_th": F.floor(F.col("h") / 3)}
    tree = build_tree(points, ["run"], ["idx"], copies=1)
    nearest(G.grid_nodes(grids, ["run"]), ["node"], tree, 1, ["idx"], ["idx"], tile=tile).explain()
    lines = capsys.readouterr().out.splitlines()
    # What lies below a broadcast is indented deeper than it; what is dealt out first is measured before it is sent.
    for n, line in enumerate(lines):
        if "BroadcastExchange" in line:
            deep = line.index("BroadcastExchange")
            stop = next((m for m in range(n + 1, len(lines)) if len(lines[m]) - len(lines[m].lstrip(" :+-")) <= deep), len(lines))
            assert not any("Generate" in x for x in lines[n + 1: stop]) or any("hashpartitioning" in x for x in lines[n + 1: stop])
