"""What queries write to the shared folder grows with the columns they need, not with the width of their input."""

import os

from pyspark.sql import functions as F

from cargoloom.plans import loads, reports
from cargoloom.sources.tables import StarSchemaTables

WIDE, MOST = "x" * 4000, 3_000_000


def written(spark, run):
    root = spark.conf.get("spark.checkpoint.dir")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs)
    before = size()
    out = run()
    return out, size() - before


def test_request_lines_are_written_without_unprinted_columns(spark):
    t = StarSchemaTables(spark, "/root/testdata/sf0.001")
    lines = t.lrLineItem.withColumn("itemNote", F.concat(F.sha2(F.col("lrDetailsId"), 512), F.lit(WIDE)))
    out, size = written(spark, lambda: reports.request_print_lines(t.replace(lrLineItem=lines)))
    assert size < MOST and out.count() > 1000


def test_work_order_lines_are_written_compressed(spark):
    t = StarSchemaTables(spark, "/root/testdata/sf0.001")
    out, size = written(spark, lambda: reports.work_order_print(t.replace(soLineItem=t.soLineItem.withColumn("soItemDesc", F.lit(WIDE)))))
    assert size < MOST and out.where("recordType = 'OL' AND length(itemDesc) = 4000").count() > 1000


def test_loaded_orders_are_written_without_what_only_the_rules_need(spark):
    t = StarSchemaTables(spark, "/root/testdata/sf0.001")
    staged = t.temp_SoFilelog.withColumn("destination", F.concat("destination", F.repeat(F.lit(" "), F.lit(4000))))
    checked, size = written(spark, lambda: loads.check_sales_order_file(t.replace(temp_SoFilelog=staged), "1996-01-01", strict=False))
    assert size < MOST and checked.errors.count() > 100 and checked.accepted.count() > 100
