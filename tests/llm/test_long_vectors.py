"""Exact search when norms differ by many orders of magnitude."""

import numpy as np
import pytest

from poseweave.llm import vptree


def by_definition(points, query, own, k):
    scores = vptree.products(points[query], points)
    order = np.lexsort((np.arange(len(points)), -scores))
    return [(int(i), float(scores[i])) for i in order if i != own][:k]


@pytest.mark.parametrize("norm", [1.0, 1e4, 1e8, 1e12])
def test_one_long_vector_loses_no_neighbour(spark, norm):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(1500, 24))
    points /= np.linalg.norm(points, axis=1)[:, None]
    points[700] *= norm
    points[1200] = points[40]
    frame = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = {}
    for r in vptree.nearest(frame, k=7, every=50, shard_rows=400).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert len(got) == 30
    for query, found in got.items():
        assert [found[n] for n in range(1, 8)] == by_definition(points, query, query, 7)
