"""Time the headline queries: BENCH_SF_DIR (data), BENCH_CPUS (local cores). Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pageloom.plans.catalog import QUERIES  # noqa: E402
from pageloom.session import build_session  # noqa: E402

HEADLINE = (
    "html_nodes", "page_title", "auto_content", "resolve_content", "site_boilerplate", "links", "extract_images",
    "plan_media", "segment_blocks", "token_integrity", "content_items", "politeness_schedule", "expand_sitemaps",
)
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    pages = QUERIES["load_pages"](spark, sf_dir).count()
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(1 + RUNS):  # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": Path(sf_dir).name[2:],
        "pages": pages, "pages_per_sec_full_conversion": round(pages / times["content_items"], 1), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
