"""Wall time of the headline queries; prints one JSON line.

Every query starts from the raw tables: the tables that queries share within a session are dropped
between runs, and one small warm-up run loads the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import catalog  # noqa: E402
from cadenza.session import local_session  # noqa: E402

HEADLINE = ["p7_diatonic_share", "w1_segments", "a1_segment_candidates", "j3_neighbours", "a5_key_emissions", "w6_key_path", "w7_key_posteriors",
            "w8_merged_keys", "a6_global_key", "r1_ii_v_i", "r3_secondary_dominant", "r6_borrowed_chords", "r8_deceptive_cadence",
            "r11_kept_progressions", "r15_resolved_events", "j9_greedy_matches", "a17_chord_scores", "t6_parameter_sweep",
            "w12_beat_grid", "w19_chord_decoding", "w13_novelty"]


def run(spark, name: str, sf_dir: str) -> float:
    catalog.forget()
    start = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in catalog.QUERIES]
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    run(spark, "r15_resolved_events" if os.path.isdir(small) and not sys.argv[1:] else names[0], small if os.path.isdir(small) else sf_dir)
    times = {n: round(run(spark, n, sf_dir), 3) for n in names}
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
