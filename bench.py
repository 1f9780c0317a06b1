"""Headline queries, one JSON line: python bench.py.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trajgraph.catalog import load  # noqa: E402
from trajgraph.session import build_session  # noqa: E402

HEADLINE = {
    "action_pair_freq": "P05_action_pair_freq",
    "merge_pair": "P07_merge_pair",
    "bpe_mine": "P06_bpe_mine",
    "task_paths": "P01_task_paths",
    "graph_fold": "G04_fold_trajectories",
    "topk_cosine": "V02_topk_cosine",
    "threshold_search": "V04_threshold_search",
    "q_targets": "T07_q_targets",
    "topk_leaf_paths": "T06_topk_leaf_paths",
    "beam_paths": "T02_beam_paths",
    "episode_rollup": "E01_episode_rollup",
    "token_running_totals": "E04_token_running_totals",
    "removal_integrity": "E20_removal_integrity",
    "addition_integrity": "E21_addition_integrity",
    "playlist_rownum": "J07_playlist_rownum_join",
    "track_visits": "E31_track_visits_in_order",
    "fuzzy_join": "K06_fuzzy_join",
    "xml_elements": "K03_xml_elements",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = build_session("bench", cores=cpus)
    registry = load()
    # Start the JVM, the readers and a Python worker before timing.
    registry["V03_vector_stats"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    registry["U01_fuzzy_match"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name, key in HEADLINE.items():
        if len(sys.argv) > 1 and name not in sys.argv[1:]:
            continue
        start = time.time()
        registry[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline query seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
