"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sweepfield.bindings import collect
from sweepfield.runtime import local_session

# The reference names neighbour search, nearest neighbours and voxel aggregation as its bottlenecks.
HEADLINE = ("voxel_barycentre", "voxel_spheres", "map_first_hit", "radius_join_grouped", "pool_max", "nearest_label_transfer", "nearest_continuous",
            "pyramid_layers", "asof_pose_interpolation", "horizon_windows", "evidence_counts", "raster_future_occupancy",
            "raster_grid_visibility", "metric_confusion", "metric_threshold_sweep", "metric_average_precision", "sample_to_cap",
            "pca_local", "registration_residuals")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = collect()
    # Start the JVM's compilers and the Python workers outside the measurement.
    queries["metric_confusion"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
