"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tideline.plans import load_all  # noqa: E402
from tideline.plans.catalog import BUILDERS, runner  # noqa: E402
from tideline.session import build_session  # noqa: E402

HEADLINE = [
    "j7_pit_replay", "j8_latest_known", "j8_latest_known_many", "j9_attach_pit_evidence", "w31_detect_revisions", "a23_provenance_coverage",
    "w2_rolling_form", "w4_venue_form", "w7_head_to_head", "w12_decayed_load", "w14_exp_weighted_mean", "w20_match_features", "w27_team_strength",
    "a1_aggregate_games", "a13_transition_counts", "w25_half_innings", "d8_score_outputs", "d12_blend", "d15_fit_temperature",
    "e1_classification_metrics", "a20_performance_hierarchy", "e20_split_conformal", "e12_draw_threshold_scan", "d23_policy_build",
    "j15_matured_history", "j18_model_panel", "q1_data_quality", "q4_drift", "u2_keep_latest", "t7_tumbling_window", "w17_elo",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.log.level": "ERROR",
        "spark.ui.showConsoleProgress": "false",
    })
    load_all()
    runner(BUILDERS["a24_status_counts"])(spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's compilers
    times = {}
    for name in names:
        t0 = time.perf_counter()
        runner(BUILDERS[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
