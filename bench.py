"""Time every named query on whole sample tables; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose the data and the number of local cores. Every query runs once untimed, so
that class loading and code generation are not charged to single queries, then
once timed from building the plan to the last row (written to the no-op sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

from basketry.catalog import QUERIES
from basketry.session import build_session


def run(query, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    query.on_sample(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "basketry-bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = {name: QUERIES[name] for name in names or QUERIES}
    for query in chosen.values():
        run(query, spark, sf_dir)
    seconds = {name: round(run(query, spark, sf_dir), 3) for name, query in chosen.items()}
    spark.stop()
    report = {
        "metric": f"total of {len(seconds)} queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main(sys.argv[1:])
