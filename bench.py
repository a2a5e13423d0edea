"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from larkspan import plans  # noqa: E402
from larkspan.session import build_session  # noqa: E402

HEADLINES = [
    "cooldown_gate", "cooldown_summary", "wash_ledger", "wash_summary", "pair_labels", "bs_price_delta", "implied_vol_roundtrip", "surface_view", "bridge_apply",
    "reliability_curve", "hit_rate", "mc_entity_cached", "mc_costly", "lineup_generated", "tail_excess",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = build_session("bench", cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINES:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(median(runs), 4)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
