"""Times the 43 workload queries on a converted ``hits`` table; prints one JSON line.

Each figure is the best of three warm runs, from action start to the last row on
the driver; session, plan construction and the one conversion are excluded.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from tarnfall.plans.hits import hits
from tarnfall.plans.query import Query
from tarnfall.plans.workload import WORKLOAD
from tarnfall.session import build_session

RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench")
    try:
        hits(spark, sf_dir).write.parquet(f"{folder}/hits")
        table = Query.scan(spark, f"{folder}/hits")
        first, best = {}, {}
        for k, item in WORKLOAD.items():
            times = []
            for _ in range(RUNS + 1):
                df = item.build(table).df  # a new plan: an old one would reuse its shuffle files
                began = time.monotonic()
                df.collect()
                times.append(time.monotonic() - began)
            first[f"q{k}"], best[f"q{k}"] = round(times[0], 4), round(min(times[1:]), 4)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    out = {"metric": "workload_total_seconds", "value": round(sum(best.values()), 4), "unit": "sec", "queries": best}
    print(json.dumps(out | {"first_run": first, "cores": int(cpus), "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
