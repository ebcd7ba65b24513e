"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from texelyard.catalog import QUERIES
from texelyard.session import local_session

HEADLINE = [
    "classify_count",
    "batch_plan",
    "convert_jobs",
    "output_collisions",
    "resolve_companions",
    "resolve_triplet",
    "packed_index",
    "packed_offsets",
    "last_writer",
    "tree_nodes",
    "recent_items",
    "mip_chain",
    "mip_chain_normal",
    "downscale_x2",
    "upscale_x2",
    "display_texture",
    "load_images",
    "convert",
    "convert_files",
    "packed_slices",
    "triplet_bytes",
    "convert_jobs_pixels",
    "mip_pyramid",
    "ranged_slices",
]


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "texelyard-bench", shuffle=int(cores))
    run(spark, "classify_count", sf_dir)  # start the JVM's compilers and the Python workers
    timings = {name: run(spark, name, sf_dir) for name in HEADLINE}
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
