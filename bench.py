"""Run the headline queries and print one JSON line.

    BENCH_SF_DIR   directory of the tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from cargoloom.registry import all_queries

HEADLINE = [
    "sales_order_report", "sales_order_listing", "purchase_order_listing_by_quantity", "loading_request_listing", "po_document_items", "request_lines",
    "procurement_pending", "container_summary", "request_print_lines", "work_order_print", "commercial_invoice_lines", "running_balance", "sales_order_load_errors",
    "receipt_load_balances", "approve_sales_orders_lines", "convert_to_work_orders_lines", "ship_loading_requests_headers", "change_customer_skus_changed",
    "line_qty_notices", "versions_joined_as_of",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.shuffle.partitions", cpus).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries[HEADLINE[0]](spark, directory).limit(1).collect()  # start the JVM and the Python gateway
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        queries[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": directory.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
