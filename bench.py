"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of tables (default /root/testdata/sf0.1), BENCH_CPUS the number of
local cores. Every query is computed in full into a no-op sink after one untimed warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from asterism.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "parse_lines", "tokenize", "label_groups", "embed_hash", "csv_guard", "group_centroids",
    "nearest_centroid", "topk_similar", "covariance", "pca_2d", "kmeans_seed", "kmeans", "elbow_k",
    "build_map", "legend", "recluster", "export_csv", "export_json", "lines_map",
    "normalize_coords", "reproject", "constellation_edges", "pick_nearest", "normalize_vectors",
    "remove_component", "export_document", "place_on_saved_map", "similarity_join", "pca_by_passes", "file_lines",
    "embed_model", "nearest_document", "export_csv_file",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("asterism-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("kmeans")
    times = {name: run(name) for name in names}
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
