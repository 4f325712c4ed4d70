"""Time the headline queries on whole tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vacantia.checks.queries import queries  # noqa: E402
from vacantia.session import build_session  # noqa: E402

HEADLINE = (
    "is_us_eligible",
    "location_tier",
    "dedup_in_batch",
    "new_jobs_only",
    "parse_response",
    "rank",
    "for_digest",
    "select_within_budget",
    "html_to_text",
    "build_prompt",
    "normalise_greenhouse",
    "normalise_lever",
    "normalise_ashby",
    "normalise_adzuna",
    "workday_hydrate",
    "combine_sources",
    "save_new",
    "summarize",
    "alarm_unhealthy",
    "digest_html",
    "full_run",
    "stream_daily_summary",
    "stream_run",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(n_chars)").collect()
    known = queries()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
