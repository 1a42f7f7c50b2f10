import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from poseweave.functions.pose import Pose, apply, compose, relative, wrap_angle
from poseweave.operators import ordered as O
from poseweave.operators import trajectory as T
from poseweave.operators.thinning import decimate

POSES = "run bigint, frame bigint, x double, y double, theta double"


def literal(x, y, theta):
    return Pose(F.lit(x), F.lit(y), F.lit(theta))


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_apply_compose_and_wrap(spark):
    assert one(spark, *apply(literal(1.0, 2.0, math.pi / 2), F.lit(1.0), F.lit(0.0))) == pytest.approx([1, 3], abs=1e-12)
    a, b = literal(0.3, -1.2, 0.7), literal(-2.0, 4.5, -2.9)
    assert one(spark, *compose(a, relative(a, b))) == pytest.approx([-2.0, 4.5, -2.9], abs=1e-12)
    got = one(spark, *[wrap_angle(F.lit(v)) for v in (3 * math.pi, 0.5, 2 * math.pi + 0.25, -2 * math.pi - 0.25)])
    assert [abs(got[0]), *got[1:]] == pytest.approx([math.pi, 0.5, 0.25, -0.25], abs=1e-12)


def random_motions(spark, runs=(40, 3), seed=1):
    rng = np.random.default_rng(seed)
    rows = [(r, f, *map(float, rng.normal(size=3))) for r, n in enumerate(runs) for f in range(n)]
    return spark.createDataFrame(rows, "run bigint, frame bigint, dx double, dy double, dtheta double"), rows


def test_integration_in_blocks_equals_serial_product(spark):
    motions, rows = random_motions(spark)
    want = {}
    for run, frame, dx, dy, dt in rows:
        x, y, t = want.get((run, frame - 1), (0.0, 0.0, 0.0))
        want[run, frame] = (x + math.cos(t) * dx - math.sin(t) * dy, y + math.sin(t) * dx + math.cos(t) * dy, t + dt)
    for block in (4, 1 << 18):
        for row in T.integrate(motions, ["run"], block_rows=block).collect():
            x, y, t = want[row.run, row.frame]
            assert (row.x, row.y) == pytest.approx((x, y), abs=1e-9)
            assert row.theta == pytest.approx(math.atan2(math.sin(t), math.cos(t)), abs=1e-9)


def test_a_group_over_many_partitions_is_numbered_like_a_window(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("g"),
                                    F.hash("id").alias("v"), "id")
    own = Window.partitionBy("g")
    plain = rows.withColumns({"n": F.row_number().over(own.orderBy("v", "id")).cast("long") - 1, "t": F.count("*").over(own)})
    ranged = O.number_rows(rows, ["g"], ["v", "id"], "n", total="t")
    assert plain.exceptAll(ranged.select(*plain.columns)).count() == 0
    assert ranged.count() == 3000


def test_quantiles_interpolate(spark):
    values = np.random.default_rng(3).normal(size=501)
    df = spark.createDataFrame([(0, float(v)) for v in values] + [(1, 7.0)], "g bigint, v double")
    want = {"a": 0.5, "b": 0.9, "c": 0.333}
    got = {r.g: r for r in O.quantiles(df, ["g"], "v", want).collect()}
    for name, q in want.items():
        assert got[0][name] == pytest.approx(np.quantile(values, q))
        assert got[1][name] == 7.0


def test_look_ahead_crosses_blocks(spark):
    df = spark.range(25).select(F.lit(0).alias("run"), F.col("id").alias("frame"))
    for gap in (1, 3, 9):
        got = O.look_ahead(df, ["run"], "frame", gap, {"frame": "later"}, block_rows=4)
        assert sorted((r.frame, r.later) for r in got.collect()) == [(f, f + gap) for f in range(25 - gap)]


def test_unwrap_matches_numpy(spark):
    theta = np.random.default_rng(5).uniform(-math.pi, math.pi, 200)
    df = spark.createDataFrame([(0, i, 0.0, 0.0, float(t)) for i, t in enumerate(theta)], POSES)
    got = [r.unwrapped for r in T.unwrap(df, ["run"]).orderBy("frame").collect()]
    assert got == pytest.approx(np.unwrap(theta).tolist(), abs=1e-9)


def test_anchor_and_metrics(spark):
    df = spark.createDataFrame([(0, 0, -2.0, 6.0, math.pi), (0, 1, -5.0, 6.0, -math.pi / 2)], POSES)
    got = [(r.x, r.y, r.theta) for r in T.anchor(df, ["run"]).orderBy("frame").collect()]
    assert np.array(got) == pytest.approx(np.array([(0, 0, 0), (3, 0, math.pi / 2)]), abs=1e-9)
    truth = df.withColumn("x", F.col("x") + 1.0)
    errors = T.trajectory_errors(df, truth, ["run"]).first()
    assert errors.mean_translation_error == pytest.approx(1.0)
    assert errors.mean_relative_translation_error == pytest.approx(0.0, abs=1e-12)
    with pytest.raises(Exception, match="one trajectory only"):
        T.trajectory_errors(df, truth.where("frame = 0"), ["run"]).collect()


@pytest.mark.parametrize("poses, travel, turn, want", [
    # A straight drive in quarter metres keeps every fourth pose; turning on the spot keeps every third.
    ([(.25 * k, 2, 1) for k in range(9)], 1, 4, [0, 4, 8]),
    ([(7, -3, .2 * k) for k in range(8)], 1, .5, [0, 3, 6]),
    # Small swings over the seam of the circle are small turns.
    ([(1, 1, math.pi - .1), (1, 1, .1 - math.pi), (1, 1, math.pi - .2)], 1, .35, [0])])
def test_decimation_examples(spark, poses, travel, turn, want):
    df = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(poses)], POSES)
    assert sorted(r.frame for r in decimate(df, travel, turn).collect()) == want


def test_decimation_in_blocks_equals_serial(spark):
    rng = np.random.default_rng(8)
    path = np.cumsum(rng.normal(scale=.3, size=(60, 3)), axis=0)
    path[20:45] = path[20]  # a robot that stands still across blocks
    df = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(path)], POSES)
    serial = sorted(r.frame for r in decimate(df, .8, .7).collect())
    assert sorted(r.frame for r in decimate(df, .8, .7, block_rows=7).collect()) == serial
