"""Time the registered queries on one data folder and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_QUERIES (comma-separated names; default all). The two views that most
queries read are built first and timed as entries of their own.
"""

from __future__ import annotations

import json
import os
import sys
import time

from cohortal.catalog import QUERIES
from cohortal.session import local_session
from cohortal.sources.views import impressions, profiles

def run_all(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES")
    names = asked.split(",") if asked else list(QUERIES)
    spark = local_session(cpus, "bench", memory="16g")
    seconds: dict[str, float] = {}

    def timed(name: str, action) -> None:
        start = time.perf_counter()
        try:
            action()
        except Exception as error:
            print(f"{name}: {error}", file=sys.stderr)
            return
        seconds[name] = round(time.perf_counter() - start, 3)

    run_all(spark.range(1000).selectExpr("sum(id)"))
    timed("build_impressions", lambda: impressions(spark, sf_dir))
    timed("build_profiles", lambda: profiles(spark, sf_dir))
    for name in names:
        timed(name, lambda: run_all(QUERIES[name](spark, sf_dir)))
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
