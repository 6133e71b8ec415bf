"""Times the headline queries once warm and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lanework.plans import registry

HEADLINES = ("select_best", "explain_losers", "top_k_sources", "identity_blocks", "source_observations", "dedupe_observations", "diff_identities", "diff_sources", "diff_quality", "row_last_updated", "last_known_quality", "fill_quality", "probe_fanout", "catalog_rollup", "registry_events", "explode_entries", "match_entries")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINES:
        run = lambda: registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        run()
        start = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "catalog queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
