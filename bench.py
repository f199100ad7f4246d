"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from veritrail.plans import catalog  # noqa: E402
from veritrail.session import build_session  # noqa: E402

HEADLINE = (
    "webhook_landing", "event_dedup", "fold_payments", "extract_evidence", "structure_snapshot", "conflicts", "build_facts",
    "reconcile_pairs", "coverage_summary", "payment_reliability", "integrity", "risk_score", "fraud_signals", "trend_buckets",
    "decision_diff", "canonical_trace", "chain_verify", "defense_case_verdict", "evaluation_summary", "claim_extraction_documents",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    queries = catalog.queries()
    queries["failure_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the engine
    times = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
