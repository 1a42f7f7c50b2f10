"""Time the headline queries: one JSON line with seconds per query."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from poseweave.plans.catalog import load_all  # noqa: E402
from poseweave.session import local_session, release  # noqa: E402

HEADLINE = ["endpoint_occupancy", "trajectory_metrics", "gap_motions", "gauge_gaps", "map_from_scans", "map_samples", "nearest_points",
            "scan_normals",
            "select_pairs", "revisit_scores", "thinned_frames", "log_relations", "problem_cost", "normal_matrix",
            "map_and_pose_refinement", "streamed_trajectory"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    catalog, seconds = load_all(), {}
    # The first job also starts the JVM's threads and compiles the common operators.
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()
    for name in HEADLINE:
        start = time.perf_counter()
        catalog[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        release(spark)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
