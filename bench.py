"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from emberframe.catalog import load_all  # noqa: E402
from emberframe.session import build_session, clear_scratch  # noqa: E402

HEADLINE = (
    "new_growth_per_tile_day", "a1_rasterise_last", "a2_tile_fires", "a14_first_burn", "c31_growth_label",
    "j2_sequences", "j3_nearest_weather", "j5_nearest_vegetation", "j8_search_catalogue", "j15_dense_scaffold",
    "w1_rolling_day", "w5_choose_day", "chosen_mosaic", "a6_feature_stats", "c34_assemble_channels",
    "r1_extract_patches", "r2_closing_binary", "r3_coarse_metrics", "g1_super_fires", "m1_stratified_split",
    "l3_balanced_sample", "a17_exact_pr_summary", "m5_evaluate_models", "e1_feature_build", "e2_sample_build",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executors outside the clock
    times = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    clear_scratch(spark)
    spark.stop()
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf,
    }))


if __name__ == "__main__":
    main()
