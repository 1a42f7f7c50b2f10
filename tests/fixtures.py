"""Small scenes with known answers."""

import math


def corner(spark, init=(5.4, 4.7, 0.05), truth=(5.0, 5.0, -0.1), nodes=40):
    """Two walls x=0 and y=0 seen from two poses; the second pose starts off by some decimetres."""
    walls = [(0.0, 0.25 * s) for s in range(1, 41)] + [(0.25 * s, 0.0) for s in range(1, 41)]
    first = (4.0, 4.0, 0.2)

    def seen(at):
        c, s = math.cos(at[2]), math.sin(at[2])
        return [(c * (x - at[0]) + s * (y - at[1]), -s * (x - at[0]) + c * (y - at[1])) for x, y in walls]

    rows = [(0, frame, idx, *p) for frame, at in enumerate((first, truth)) for idx, p in enumerate(seen(at))]
    points = spark.createDataFrame(rows, "run bigint, frame bigint, idx bigint, sx double, sy double")
    poses = spark.createDataFrame([(0, 0, *first), (0, 1, *init)],
                                  "run bigint, frame bigint, x double, y double, theta double")
    c, s = math.cos(first[2]), math.sin(first[2])
    dx, dy = truth[0] - first[0], truth[1] - first[1]
    motion = (0, 0, 1, c * dx + s * dy, -s * dx + c * dy, truth[2] - first[2])
    motions = spark.createDataFrame([motion], "run bigint, i bigint, j bigint, dx double, dy double, dtheta double")
    step = 14.0 / (nodes - 1)
    grid = spark.createDataFrame([(0, nodes, nodes, -2.0, -2.0, step, step)],
                                 "run bigint, nx bigint, ny bigint, min_x double, min_y double, dx double, dy double")
    return points, poses, motions, grid, truth


def line(spark, rows, schema):
    return spark.createDataFrame(rows, schema)
