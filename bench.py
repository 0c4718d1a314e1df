"""Headline queries on local cores; prints one JSON line.

Each query is planned and run to the end (all rows produced, none kept). One untimed warm-up run of a
small query starts the JVM and the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import queries as registry  # noqa: E402
from pricetide import build_session  # noqa: E402

HEADLINE = [
    "quote_headline", "source_stats", "price_histogram", "quote_warnings", "verdicts", "result_rows",
    "listing_exclusions", "paste_roundtrip_market", "tag_identify", "search_queries", "ocr_clean_docs",
    "ocr_pass_pick", "tag_responses", "barcode_check",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        "pricetide-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    run(queries["paste_roundtrip_bare"], spark, "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else sf_dir)
    seconds = {}
    for name in names:
        seconds[name] = round(run(queries[name], spark, sf_dir), 3)
    print(json.dumps({
        "metric": "total time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))
    spark.stop()


def run(query, spark, sf_dir: str) -> float:
    begin = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


if __name__ == "__main__":
    main()
