"""Times the headline queries: one JSON line with seconds per query and their sum.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default all).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corepart.checks import QUERIES, flagship  # noqa: E402
from corepart.session import builder  # noqa: E402

HEADLINE = [
    "degree",
    "route_edges",
    "part_files",
    "seed_degree",
    "lp_core_3",
    "pagerank_10",
    "components",
    "core_extract",
    "random_walks",
    "negative_pairs",
    "sample_neighbors",
    "sage_infer",
    "embed_walks",
    "embed_sage",
    "embed_align",
    "degree_basket",
    "pagerank_basket",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = (
        builder("corepart-bench", shuffle_partitions=cpus)
        .master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(flagship(spark, sf))  # starts the JVM's compilers and the Python workers
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        run(QUERIES[name](spark, sf))
        seconds[name] = round(time.time() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
