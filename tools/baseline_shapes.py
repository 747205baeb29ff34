
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tidewright import local_session, scratch_path, spread  # noqa: E402
from tidewright.modeling import learners  # noqa: E402
from tidewright.operators import scale  # noqa: E402
from tidewright.plans import flow  # noqa: E402
from tidewright.sources import scan_csv, sink_csv, table  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session("shapes", os.environ.get("BENCH_CPUS", "8"))
    small, large = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
    run(table(spark, small, "region"))
    seconds = {}

    def timed(name, fn):
        # The first run also compiles its code; a service that is up sees the second.
        took = []
        for _ in range(2):
            started = time.perf_counter()
            out = fn()
            took.append(round(time.perf_counter() - started, 2))
        seconds[name] = took
        return out

    orders = table(spark, small, "orders")
    timed("minmax_15000_rows", lambda: run(scale.scale_numeric(orders, "o_totalprice", "minmax")))
    steps = [
        {"action": "extract_date_components", "params": {"column": "o_orderdate"}},
        {"action": "scale_numeric", "params": {"column": "o_totalprice", "method": "minmax"}},
        {"action": "encode_categorical", "params": {"column": "o_orderpriority", "method": "label"}},
    ]
    timed("three_steps_15000_rows", lambda: run(flow.apply_transformations(orders, steps)[0]))

    names = [f"x{i}" for i in range(20)]
    wide = spread(orders).select(
        "o_orderkey", "o_orderstatus", *[((F.col("o_totalprice") * (i + 1)) % (97 + i)).alias(n) for i, n in enumerate(names)]
    ).persist()
    wide.count()
    model = timed("random_forest_15000x20", lambda: learners.fit(wide, names, "o_orderstatus", "random_forest_classifier"))
    timed("predict_15000_rows", lambda: run(learners.predict_batch(model, wide, names)))

    lines = table(spark, large, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    line_model = learners.fit(lines, ["l_quantity", "l_discount"], "l_extendedprice", "linear_regression")
    timed("predict_600000_rows", lambda: run(learners.predict_batch(line_model, lines, ["l_quantity", "l_discount"])))

    csv = scratch_path(spark, "csv")
    sink_csv(table(spark, large, "lineitem"), csv)
    timed("csv_600000_rows_inferred", lambda: run(scan_csv(spark, csv)))
    print(json.dumps(seconds))


if __name__ == "__main__":
    main()
