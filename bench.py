"""Headline queries, timed: a warm-up pass, then the median of three runs of the whole plan.

BENCH_SF_DIR and BENCH_CPUS set the tables and the number of local cores. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tracklake.plans.queries import QUERIES
from tracklake.session import local_session

HEADLINE = [
    "clip_tracks",
    "clip_tracks_selective",
    "resolve_ways",
    "ways_touching",
    "ways_in_polygon",
    "offer_hashes",
    "new_files",
    "points_in_many_polygons",
    "sequential_ids",
    "artifact_freshness",
    "track_set",
    "fingerprint",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", cpus=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in HEADLINE:
        once(name)
    seconds = {}
    for name in HEADLINE:
        seconds[name] = round(statistics.median(once(name) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
