"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINES = (
    "k1_top_picks",                 # universe scan: value, medians, score, rank
    "p11_daily_scan",               # the same with entry gates and blend
    "p12_backtest",                 # scan, picks, curve, returns
    "p13_evaluate_requests",        # request table with sector comparison
    "x12_full_dcf",
    "x20_sensitivity_tables",
    "a2_sector_medians",
    "j1_as_of_price_dense",
    "w4_trend_filter",
    "w5_wilder_rsi",
    "w11_curve_metrics",
    "x19_f_score",
    "a8_covariance",
    "a9_tail_risk",
    "v6_portfolio_var",             # 10,000 paths x 21 days per portfolio
    "p10_hedge_plan",
    "p6_cent_allocation",
    "l6_sensitivity_reconciliation",
    "l9_company_extraction",
    "f19_email_scan",
    "s21_hash_manifest",
    "t1_attempt_limit",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from tidemark.plans import load

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()
    spark.read.parquet(f"{SF_DIR}/region.parquet").count()
    names = [n for n in HEADLINES if not sys.argv[1:] or n in sys.argv[1:]]
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
