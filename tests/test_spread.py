"""Few keys with many rows: the rows of one key are spread over tasks, and what is written stays narrow."""

import os

import pytest
from pyspark.sql import functions as F

from cargoloom.operators.history import notify_recipients
from cargoloom.operators.lookup import rate_at
from cargoloom.operators.validate import Rule, validate
from cargoloom.plans import reports
from cargoloom.sources.tables import StarSchemaTables, Tables


@pytest.fixture
def no_broadcast(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def parts(df):
    return df.select(F.spark_partition_id()).distinct().count()


def test_rows_of_one_rate_are_spread(spark, no_broadcast):
    rates = spark.createDataFrame([(1, "SGD", "USD", "1999-01-01", "1999-12-31", 7, 1, 1), (1, "sgd", "USD", "1999-06-01", "1999-12-31", 8, 2, 1)],
                                  "companyId int, homeCurrency string, foreignCurrency string, startDate string, endDate string, foreignRate int, rateId int, status int")
    rows = spark.range(500).select("id", F.when(F.col("id") < 490, 1).alias("c"), F.lit("SGD").alias("h"), F.lit("USD").alias("f"), F.lit("1999-07-01").alias("d"))
    out = rate_at(rows.unionByName(rows), rates, "c", "h", "f", "d")
    assert parts(out.where("c = 1")) > 4
    assert out.count() == 1000 and {(r.c, r.rate) for r in out.collect()} == {(1, 8), (None, None)}


def test_few_notices_are_spread_over_the_tasks(spark):
    notices = spark.range(40, numPartitions=1).select(F.lit(1).alias("companyId"), F.lit("SalesOrder").alias("sourceModule"), F.col("id").alias("sourceRecordId"))
    users = spark.range(5).select(F.col("id").alias("userId"), F.lit(1).alias("status"))
    t = Tables({"userRole": users.select("userId", F.lit(13).alias("userrolecompanyroleid")), "md_User": users,
                "companyRole": spark.createDataFrame([(13, 1, 3)], "companyRoleId int, companyId int, roleId int"), "md_Role": spark.createDataFrame([(3, "sales")], "roleId int, roleName string")})
    out = notify_recipients(notices, t, exclude_user=1)
    assert out.count() == 160 and parts(out) > 4


def test_messages_are_not_written_with_the_rows(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs)
    rows = spark.range(200).select(F.col("id").alias("row"), (F.col("id") % 2).alias("file"))
    validate(rows.limit(1), [Rule("x", F.col("row") < 0)], "row", ["file"])  # sets the folder
    before = size()
    checked = validate(rows, [Rule("x" * 5000 + " {}", F.col("file") == 1, F.col("row"))], "row", ["file"])
    assert size() - before < 500_000
    assert checked.errors.count() == 100 and {len(r.rule) for r in checked.errors.collect()} == {5003} and checked.accepted.count() == 100


def test_orders_of_internal_customers_stand_for_the_order_they_name(spark):
    t = StarSchemaTables(spark, "/root/testdata/sf0.001")
    inside = {r.customerId for r in t.md_Customer.where("internal_branchId <> 0").collect()}
    orders = t.soHeader.collect()
    ids = {r.soName.lower(): r.soHeaderId for r in orders}
    stands = {r.soHeaderId: ids.get(r.reference1.lower(), r.soHeaderId) if r.customerId in inside else r.soHeaderId for r in orders}
    carried = {r.soHeaderId for r in t.lrLineItem.select("soHeaderId").distinct().collect()}
    got = {r.soHeaderId: r.volume is not None for r in reports.customer_di_checklist(t).collect()}
    assert any(k != v for k, v in stands.items()) and got == {k: v in carried for k, v in stands.items()}
