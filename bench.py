"""Seconds per named query, as one JSON line. Each query runs once to warm up and is then timed once."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


def drain(df) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from glossaframe import local_session
    from glossaframe.plans import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(QUERIES)
    spark = local_session(cpus, shuffle_partitions=cpus, app="glossaframe-bench", memory=os.environ.get("BENCH_MEMORY", "12g"))
    seconds: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in wanted:
        try:
            if Path(warm).is_dir():
                drain(QUERIES[name](spark, warm))
            start = time.perf_counter()
            drain(QUERIES[name](spark, sf_dir))
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as error:
            failed[name] = str(error).splitlines()[0][:200]
        print(f"{name}: {seconds.get(name, failed.get(name))}", file=sys.stderr, flush=True)
    line = {"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
            "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus}
    if failed:
        line["failed"] = failed
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
