"""Headline queries on one machine: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and
the cores; BENCH_RUNS the number of timed runs after one warm-up, of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docloom.catalog import QUERIES  # noqa: E402
from docloom.session import local_session  # noqa: E402

HEADLINE = [
    "G02_exact_search",
    "G02_exact_search_blocks",
    "G04_ivf_search",
    "M03_chunk_texts",
    "M07_embed_chunks",
    "F03_stale_keys",
    "F04_apply_to_vectors",
    "F04_apply_to_cells",
    "B06_upsert_vectors",
    "C02_route_requests",
    "C14_expand_requests",
    "C18_document_lines",
    "F05_source_links",
    "H04_first_answers",
    "H10_hits_with_content",
    "H21_answer_questions",
    "P01_ingest_contents",
    "P04_stored_cells",
    "S01_minute_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "headline queries, sum of medians",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
