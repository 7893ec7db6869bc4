"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default: all)
BENCH_QUERIES  comma list of query names (default: the headline set; ``all`` for every query)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from docquarry.gallery import QUERIES
from docquarry.session import build_session

HEADLINE = (
    # predicates: scan only, in-row arrays, row-stored arrays, VARIANT bodies
    "flagship no_order_line independent_line_predicates contains_string nested_iteration "
    "hasmember_string quantity_literal open_layout_numbers mixed_corpus_numbers isa "
    # structure and lookups
    "header flatten_fields explode_structures matrix_rows dependencies "
    "follow walk dangling_dependencies mistyped_dependencies directory_tree manifest_entries expand_curies "
    # roll-ups, validation, quantities, migration, streams
    "class_counts topic_rollup session_summary duplicate_ids validation_summary array_element_rules "
    "nested_element_rules quantity_rules quantity_duration quantity_frequency "
    "migrate_treatment migrate_element_epoch migrate_contrast_tuning migration_report "
    "stream_validate stream_dedupe_ids"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": str(os.cpu_count() if cpus == "*" else cpus),
            "spark.log.level": "ERROR",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    # Warm the JVM's code paths outside the clock: one typed scan, one VARIANT query.
    for name in ("flagship", "mixed_corpus_numbers", "migrate_probe_location"):
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
