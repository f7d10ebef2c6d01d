"""Wall seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from graintide import registry
from graintide.session import local_session

HEADLINE = ("date_quality", "freshness_by_commodity", "warehouse_counts", "dedupe_keep_lowest_id", "rolling_price_trend", "monthly_volatility", "upsert_prices", "deficiency_ranking", "price_dispersion", "running_monthly_sales", "rdd_local_linear", "spec_curve")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 8)
    spark.sparkContext.setLogLevel("OFF")
    found = registry.queries()
    found[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        began = time.time()
        found[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
