"""Headline queries on the driver's tables: prints one JSON line of seconds, of each query the median of three runs after the session is warm.

The text index is built before the searches and its time given apart, as index_build; it is part of the total.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from spindle.session import session
from spindle import workload

HEADLINE = [
    "match_label_rel", "match_asof", "edges_as_of", "backlinks", "degree_centrality", "neighbours_d2", "shortest_path", "fts_and", "fts_phrase", "vector_topk", "hybrid_rrf",
    "datelist_encode", "cohort_pairs", "retention_rollup", "diff_states", "upsert_edge_latest", "update_equals_rebuild", "co_change", "heading_in_force", "wikilink_resolution",
    "classify_paths", "cold_rollup",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"), "bench")
    seconds = {}
    workload.QUERIES["match_asof"](spark, folder).write.format("noop").mode("overwrite").save()
    for name in sys.argv[1:] or HEADLINE:
        if name.startswith("fts_") and "index_build" not in seconds:
            began = time.perf_counter()
            workload.d_index(spark, folder)
            seconds["index_build"] = round(time.perf_counter() - began, 3)
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            workload.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(runs), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
