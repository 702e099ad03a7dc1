"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). BENCH_KEYS is a
comma list of query keys, or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "TOP5", "SEL6", "SEL8", "JN5", "JN6", "JN7", "JN11", "JN12", "WIN1", "WIN2", "WIN3", "WIN8", "WIN9",
    "AGG2", "AGG6", "AGG9", "AGG20", "SIM4", "SIM5", "GR4", "GR7", "SEQ12", "FDR1", "FDR5", "QRY1", "QRY3", "QRY6", "ML7", "ML8",
]


def main() -> None:
    from peakloom.plans.catalog import REGISTRY, spark_callable
    from peakloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_KEYS", "")
    keys = list(REGISTRY) if wanted == "all" else [k for k in wanted.split(",") if k] or HEADLINE
    spark = build_session(f"local[{cpus}]", "peakloom-bench", **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for key in keys:
        start = time.time()
        try:
            spark_callable(key)(spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001
            print(f"{key} failed: {str(e)[:300]}", file=sys.stderr, flush=True)
            continue
        times[key] = round(time.time() - start, 3)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}
        )
    )


if __name__ == "__main__":
    main()
