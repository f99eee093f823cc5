"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from assayframe.session import local_session
from workload.queries import queries
from workload.securities import securities

HEADLINE = (
    "rule_counts", "summary", "missing_values", "id_check_digit", "date_order", "coupon_by_type",
    "name_state_mismatch", "duplicate_ids", "duplicate_rows", "inconsistent_casing", "value_concentration",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    start = time.perf_counter()
    rows = securities(spark, sf_dir).count()
    timed = {"derive_table": round(time.perf_counter() - start, 3)}
    registered = queries()
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timed[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(timed.values()), 3), "unit": "sec",
        "queries": timed, "sf": os.path.basename(sf_dir.rstrip("/")), "rows": rows,
    }))


if __name__ == "__main__":
    main()
