"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the threads.  Deriving the ledger
from the sample tables is timed on its own; every query is run once to warm up and then three times, and the
median counts.  One whose first run takes longer than BENCH_LONG seconds (default 15) is run once more, one that takes four times as long not at all: its
first run counts.  After BENCH_LIMIT seconds (default 1500), or on SIGTERM, the figures so far are printed.  Results go to Spark's noop
sink, so every row is produced and none is collected.
"""

from __future__ import annotations

import json
import os
import signal
import statistics
import sys
import time

from pyspark.sql import SparkSession

from hearth.catalog import all_queries
from hearth.operators.base import session_defaults
from hearth.schema import SCHEMAS
from hearth.sources.star import star_ledger

HEADLINE = [
    "find_transactions", "spend_entries", "month_categories", "month_totals", "month_stores", "missing_receipts", "month_metrics",
    "month_category_metrics", "period_stats", "category_averages", "spend_movers", "spend_pace", "stock_summary", "waste_score",
    "stock_duplicates", "pantry_deficits", "price_inflation", "regular_essentials", "pair_transfers", "mirror_payments",
    "match_receipts", "subscription_items", "resolve_instruments", "investment_years", "check_receipts", "load_receipts",
    "load_statements", "apply_stock_events", "category_usage", "statement_documents",
    "plan_check", "recheck_batches", "apply_answers", "apply_mirrors", "stream_stock", "stream_ingest",
]


class _Stopped(Exception):
    pass


def _stop(*_) -> None:
    raise _Stopped


def _seconds(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    begun = time.perf_counter()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    long, limit = float(os.environ.get("BENCH_LONG", "15")), float(os.environ.get("BENCH_LIMIT", "1500"))
    spark = (
        session_defaults(SparkSession.builder.master(f"local[{cpus}]").appName("hearth-bench"))
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    single, names = [], sys.argv[1:] or HEADLINE
    signal.signal(signal.SIGTERM, _stop)
    try:
        times["derive_ledger"] = _seconds(lambda: [getattr(star_ledger(spark, sf_dir), table) for table in SCHEMAS])
        found = all_queries()
        for name in names:
            if time.perf_counter() - begun > limit:
                break
            run = lambda name=name: found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            first = _seconds(run)
            again = runs if first < long else int(first < 4 * long)
            times[name] = statistics.median([_seconds(run) for _ in range(again)] or [first])
            single += [name] if again < runs else []
    except _Stopped:
        pass
    print(json.dumps({
        "metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": {n: round(t, 3) for n, t in times.items()}, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "runs": runs, "single_run": single, "not_run": [n for n in names if n not in times],
    }), flush=True)


if __name__ == "__main__":
    main()
