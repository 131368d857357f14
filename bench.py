"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is fully executed (``write.format("noop")``, so no result is pulled
to the driver) ``$BENCH_RUNS`` times (3 if unset); its time is the median, so the
run that compiles its code does not decide. Value = sum of the headline query
times. Rows a second are those of the table that the query reads.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "resolve_requests",
    "redirect_outcomes",
    "click_enrich",
    "coalesce_clicks",
    "shard_distribution",
    "page_numbers",
    "sliding_window_limit",
    "token_bucket_limit",
    "tiered_limit",
    "ttl_first_touch",
    "cache_effectiveness",
    "inflight_collapse",
    "failure_episodes",
    "request_counts",
    "latency_histogram",
    "validate_links",
    "mint_ids",
]
#: The given table that a query reads, where it is not ``events``.
READS = {"shard_distribution": "orders", "page_numbers": "orders", "validate_links": "pages"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from linklens.plans import catalog
    from linklens.session import build_session

    spark = build_session(f"local[{cpus}]", max(8, int(cpus)), app="linklens-bench",
                          extra={"spark.driver.memory": "8g"})
    catalog.load_all()
    names = [n for n in HEADLINE if n in catalog.QUERIES]
    # Warm-up: JIT and Python workers, on the smallest query.
    catalog.QUERIES["coalesce_clicks"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times: dict[str, float] = {}
    for name in names:
        took = []
        for _ in range(runs):
            t0 = time.perf_counter()
            df = catalog.QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t0)
        times[name] = round(median(took), 3)
    sizes = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in {"events", *READS.values()}}
    rows = {name: sizes[READS.get(name, "events")] for name in names}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "runs": runs, "rows": rows,
                      "rows_per_sec": {name: round(rows[name] / max(t, 1e-3), 1) for name, t in times.items()}}))
    spark.stop()


if __name__ == "__main__":
    main()
