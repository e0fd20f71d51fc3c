"""What a plan leaves on disk while it is built: no shuffle files of ended jobs, and no rows that nothing reads any more."""

import os
import time

from pyspark.sql import functions as F

from cargoloom.llm.common import stored
from cargoloom.operators.ordering import SHUFFLES_END, ordinal, removed_rows, shared_checkpoint, shared_rows
from cargoloom.operators.validate import flag_groups, repeats
from cargoloom.plans.loads import check_sales_order_file, orders_holding
from cargoloom.sources.tables import StarSchemaTables


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = set()
    while files.hasNext():
        name = files.next().getName()
        if name.startswith("shuffle_"):
            found.add(name)
    return found


def left_after(spark, run):
    before, out = shuffle_files(spark), run()
    end = time.time() + 10
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    return out, shuffle_files(spark) - before


def folders(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    return {d for d in os.listdir(root) if any(f.endswith(".parquet") for _, _, fs in os.walk(os.path.join(root, d)) for f in fs)}


def numbers(spark):
    return spark.range(1000).select("id", (F.col("id") % 7).alias("k")).repartition(4, "k")


def test_shuffle_files_go_when_rows_are_written(spark):
    for write in (shared_rows, shared_checkpoint, lambda df: stored(df, "t")):
        out, left = left_after(spark, lambda: write(numbers(spark).groupBy("k").count().repartition(3, "count")))
        assert not left and sorted(r["k"] for r in out.collect()) == list(range(7))
    assert spark.conf.get(SHUFFLES_END, None) in (None, "false")  # the caller's own queries are as they were


def test_numbering_leaves_no_shuffled_rows(spark):
    out, left = left_after(spark, lambda: ordinal(numbers(spark), ["id"], within=["k"]))
    assert len({name.split("_")[1] for name in left}) <= 1  # asking whether rows tie moves a row of each task
    assert {(r["id"], r["rowNo"]) for r in out.collect()} == {(i, i // 7 + 1) for i in range(1000)}


def test_rows_of_a_frame_that_was_made_before_are_kept(spark):
    df = numbers(spark).groupBy("k").count()
    assert df.count() == 7
    shared_checkpoint(df)
    assert df.count() == 7 and df.collect()


def test_groups_are_flagged_from_compressed_rows(spark):
    root, before = spark.conf.get("spark.checkpoint.dir"), folders(spark)
    rows = spark.range(2000).select("id", F.repeat(F.lit("x"), 2000).alias("wide"))
    assert flag_groups(rows, [(["id"], {"_twice": repeats()})], written=True).where("NOT _twice").count() == 2000
    new = folders(spark) - before
    assert new and sum(os.path.getsize(os.path.join(d, f)) for n in new for d, _, fs in os.walk(os.path.join(root, n)) for f in fs) < 1_000_000


def test_spent_rows_are_removed(spark):
    before = folders(spark)
    kept, spent = shared_rows(numbers(spark)), shared_rows(numbers(spark))
    removed_rows(spent)
    assert len(folders(spark) - before) == 1 and kept.count() == 1000


def test_pieces_of_texts_are_removed_when_the_orders_are_found(spark):
    schema = "companyId int, customerId int, customerPO string"
    asked, orders, before = spark.createDataFrame([(1, 1, "PO12"), (1, 1, "PO9")], schema), spark.createDataFrame([(1, 1, "x PO123")], schema), folders(spark)
    assert [r["_po"] for r in orders_holding(asked, orders).collect()] == ["po12"]
    assert len(folders(spark) - before) <= 1


def test_rules_name_the_texts_that_are_not_carried_on(spark):
    t = StarSchemaTables(spark, "/root/testdata/sf0.001")
    one = t.temp_SoFilelog.limit(1).withColumns({"customerName": F.lit("Nobody "), "orderQty": F.lit("x"), "shipDate": F.lit("2999-01-01"), "customerPO": F.lit("QQQ"), "destinationlabel": F.lit("")})
    keys = {r["ruleNo"]: r["key"] for r in check_sales_order_file(t.replace(temp_SoFilelog=one), "1996-01-01").errors.collect()}
    assert keys == {6: "x", 7: "Nobody "}
    known = t.temp_SoFilelog.where("trim(customerName) <> '' AND customerName <> 'Unknown'").limit(1).withColumns({"destinationlabel": F.lit(" "), "destination": F.lit("nowhere"), "shipDate": F.lit("2999-01-01"), "orderQty": F.lit("3")})
    keys = {r["ruleNo"]: r["key"] for r in check_sales_order_file(t.replace(temp_SoFilelog=known), "1996-01-01").errors.collect()}
    assert keys.get(9) == "nowhere" and not {1, 6, 7, 10} & set(keys)
