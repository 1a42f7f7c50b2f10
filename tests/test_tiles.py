import numpy as np

from poseweave.operators import gridmap as G
from poseweave.operators import residuals as R


def test_nodes_meet_their_neighbours_in_tiles(spark):
    """Over several tiles, with holes and a null value; few nodes travel more than once."""
    nx, ny = 70, 40
    rng = np.random.default_rng(3)
    values = {(w, h): float(v) for (w, h), v in zip(((w, h) for h in range(ny) for w in range(nx)), rng.normal(size=nx * ny))}
    for hole in ((31, 5), (32, 32), (0, 39)):
        del values[hole]
    values[64, 10] = None
    nodes = spark.createDataFrame([(7, h * nx + w, w, h, v) for (w, h), v in values.items()], "run bigint, node bigint, w bigint, h bigint, value double")
    grids = spark.createDataFrame([(7, nx, ny, 0.0, 0.0, 2.0, 0.5)], "run bigint, nx bigint, ny bigint, min_x double, min_y double, dx double, dy double")
    assert G._tiled(nodes, ["run"], ["value"], 0).count() < 1.15 * len(values)
    got = {(r.cw, r.ch): tuple(r[f"value_{t}"] for t in G.CORNERS) for r in G.patches(nodes, ["run"]).collect()}
    want = {(w, h): tuple(values[w + a, h + b] for a, b in G.OFFSETS) for w, h in values if all((w + a, h + b) in values for a, b in G.OFFSETS)}
    assert got == want
    slopes = {(r.w, r.h): (r.grad_x, r.grad_y) for r in G.node_gradients(nodes, grids, ["run"]).collect()}
    assert slopes.keys() == {k for k, v in values.items() if v is not None}
    for (w, h), found in slopes.items():
        for (a, b), step, slope in (((1, 0), 2.0, found[0]), ((0, 1), 0.5, found[1])):
            low, high = values.get((w - a, h - b)), values.get((w + a, h + b))
            span = step * ((low is not None) + (high is not None))
            assert abs(slope - ((values[w, h] if high is None else high) - (values[w, h] if low is None else low)) / span) < 1e-12


def test_specs_are_made_in_one_pass(spark):
    """Scan rows and hallucinated rows come from one reading of the points, which stay where they are."""
    points = spark.createDataFrame([(1, 0, 0, 3.0, 4.0), (1, 0, 1, 0.0, 0.0)], "run bigint, frame bigint, idx bigint, sx double, sy double")
    specs = R.point_specs(points, R.ProblemOptions(hallucination=R.Hallucination(2, 0.5, True)))
    assert "Union" not in specs._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.row, round(r.sx, 9), round(r.sy, 9), r.delta) for r in specs.collect())
    assert got == [(0, 3.0, 4.0, 0.0), (1, 2.7, 3.6, 0.5), (2, 3.3, 4.4, -0.5), (3, 0.0, 0.0, 0.0)]
