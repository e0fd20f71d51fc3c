"""Open order lines without a warehouse come out as errors."""

from pyspark.sql import functions as F

from cargoloom.plans import conversions
from cargoloom.sources.tables import StarSchemaTables


def test_lines_without_warehouse_are_errors(spark):
    t = StarSchemaTables(spark, "/root/testdata/sf0.001")
    every = {r.soLineItemId for r in conversions.convert_to_work_orders(t, "1999-06-30").lines.collect()}
    gone = {r.soHeaderId for r in t.soHeader.collect() if r.soHeaderId % 3 == 0}
    out = conversions.convert_to_work_orders(t.replace(soHeader=t.soHeader.withColumn("locNo", F.when(F.col("soHeaderId") % 3 == 0, "NOWHERE").otherwise(F.col("locNo")))), "1999-06-30")
    made, errors = {r.soLineItemId for r in out.lines.collect()}, out.errors.collect()
    assert made and errors and made | {r.soLineItemId for r in errors} == every and not made & {r.soLineItemId for r in errors}
    assert {r.key for r in errors} == {"NOWHERE"} and {r.soHeaderId for r in errors} <= gone
