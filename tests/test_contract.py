import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as contract  # noqa: E402

from poseweave.plans.catalog import load_all  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
QUICK = ["endpoint_occupancy", "trajectory_metrics", "nearest_points", "select_pairs", "log_relations", "pcd_round_trip",
         "eikonal_residuals"]


def test_every_check_belongs_to_a_query():
    queries, checks = contract.queries(), contract.oracle_sql()
    assert set(checks) <= set(queries)
    own = load_all()
    assert {name for name in own if name not in checks} == {"map_and_pose_refinement", "icp_relations", "icp_odometry"}
    assert set(own) <= set(queries)


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    from check_sql import compare, duck

    got = contract.queries()[name](spark, str(DATA)).toPandas()
    want = duck(str(DATA)).execute(contract.oracle_sql()[name]).df()
    assert len(got) and compare(got, want) is None
