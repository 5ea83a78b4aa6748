"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "settlement_by_market", "expected_value_and_kelly", "devig_multiplicative", "odds_family_coalesce", "closing_line_value", "backtest_summary", "calibration_by_market", "reliability_table",
    "rolling_stats_skip_missing", "rolling_form", "match_density", "point_in_time_imputation", "equity_curve", "max_drawdown", "longest_losing_streak", "as_of_quote", "nearest_result_within_a_day",
    "three_pass_odds_ladder", "best_leg_per_match", "daily_slots", "score_matrix_1x2", "over_under_masses", "fair_total_line", "fit_team_strengths", "greedy_exposure", "team_profile",
)


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from touchline import registry

    def run(name: str) -> float:
        began = time.perf_counter()
        registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    run(HEADLINE[0])  # the first query also starts the engine
    took = {}
    for name in HEADLINE:
        try:
            took[name] = round(run(name), 3)
        except Exception as e:  # noqa: BLE001  a failing query is reported and the others still run
            print(f"{name}: {e}", file=sys.stderr)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
