"""Files, published versions and streams: replays, duplicates, late rows, no-op updates."""

import json

import pytest
from pyspark.sql import functions as F

from cargoloom.operators.history import notify_recipients
from cargoloom.plans.digests import new_sales_orders
from cargoloom.sources import cells
from cargoloom.sources.files import current_version, publish, read_published, read_staged, write_template
from cargoloom.sources.tables import StarSchemaTables
from cargoloom.streaming import feeds

CHANGE = "changeId long, companyId int, sourceModule string, sourceRecordId long, column string, oldValue string, newValue string, changedAt timestamp, arrivedAt timestamp"


def put(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def change(i, old, new, at="2024-01-01 10:00:00", arrived="2024-01-01 10:00:05"):
    return dict(changeId=i, companyId=1, sourceModule="WorkOrder", sourceRecordId=i, column="qty", oldValue=old, newValue=new, changedAt=at, arrivedAt=arrived)


def test_notice_stream(spark, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"

    def run():
        feeds.notice_stream(feeds.read_changes(spark, str(src), CHANGE), str(out), str(ck), ["changeId"]).awaitTermination()

    put(src, "a.json", [change(1, "5", "6"), change(2, "7", "7"), change(3, None, "1"), change(4, "1", "2", arrived="2024-01-01 12:30:00")])
    run()
    notices = lambda: spark.read.parquet(f"{out}/notices")
    assert sorted(r.sourceRecordId for r in notices().collect()) == [1, 3]
    assert [r.changeId for r in spark.read.parquet(f"{out}/late").collect()] == [4]
    put(src, "b.json", [change(1, "5", "6"), change(5, "2", "3")])  # a change delivered again, and a new one
    run()
    assert sorted(r.sourceRecordId for r in notices().collect()) == [1, 3, 5]
    run()  # nothing new
    assert notices().count() == 3
    # a row eight hours late, long behind the newest event, delivered twice; and the first late row once more
    put(src, "c.json", [change(6, "1", "2", at="2024-01-02 10:00:00", arrived="2024-01-02 10:00:05")])
    run()
    late = change(7, "1", "9", at="2024-01-01 09:00:00", arrived="2024-01-02 11:00:00")
    put(src, "d.json", [late, late, change(4, "1", "2", arrived="2024-01-02 11:00:00")])
    run()
    put(src, "e.json", [late, change(1, "5", "6", arrived="2024-01-02 12:00:00")])
    run()
    assert sorted(r.changeId for r in spark.read.parquet(f"{out}/late").collect()) == [4, 7]
    assert sorted(r.sourceRecordId for r in notices().collect()) == [1, 3, 5, 6]


HEAD = "workOrderHeaderId long, companyId int, workOrderName string, targetCompleteDate date, version int"


def test_image_stream_compares_with_the_published_table(spark, tmp_path):
    root, src, out, ck = (str(tmp_path / n) for n in ("table", "in", "out", "ck"))
    base = spark.createDataFrame([(1, 1, "W1", "2024-01-01"), (2, 1, "W2", "2024-01-01")], "workOrderHeaderId long, companyId int, workOrderName string, d string") \
        .withColumn("targetCompleteDate", F.col("d").cast("date")).drop("d").withColumn("version", F.lit(0))
    of = cells.successor(spark, root, "first")
    cells.put_table(base, root, "workOrderHeader", of, cells.hash_cell("workOrderHeaderId"))
    cells.commit(spark, root, of)
    lines = spark.createDataFrame([(1, 100), (1, 101), (2, 200)], "workOrderHeaderId long, soHeaderId long")
    put(tmp_path / "in", "a.json", [dict(workOrderHeaderId=1, companyId=1, workOrderName="W1", targetCompleteDate="2024-01-02", version=1),
                                    dict(workOrderHeaderId=1, companyId=1, workOrderName="W1", targetCompleteDate="2024-01-09", version=2),
                                    dict(workOrderHeaderId=2, companyId=1, workOrderName="W2", targetCompleteDate="2024-01-01", version=1)])
    images = spark.readStream.schema(HEAD).json(src)
    feeds.image_stream(images, root, "workOrderHeader", "workOrderHeaderId", "version", feeds.target_date_compare(lines), out, ck).awaitTermination()
    notices = spark.read.parquet(out)
    assert sorted((r.sourceModule, r.sourceRecordId) for r in notices.collect()) == [("SalesOrder", 100), ("SalesOrder", 101), ("WorkOrder", 1)]
    assert '"newValue":"2024-01-09"' in notices.first().payload
    after = {r.workOrderHeaderId: str(r.targetCompleteDate) for r in cells.read_table(spark, root, "workOrderHeader").collect()}
    assert after == {1: "2024-01-09", 2: "2024-01-01"}
    again = spark.readStream.schema(HEAD).json(src)  # the same files under a new checkpoint: batch 0 is the current version
    feeds.image_stream(again, root, "workOrderHeader", "workOrderHeaderId", "version", feeds.target_date_compare(lines), out, str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_an_older_image_does_not_move_the_table_back(spark, tmp_path):
    root, out, ck = (str(tmp_path / n) for n in ("table", "out", "ck"))
    row = lambda date, version: dict(workOrderHeaderId=1, companyId=1, workOrderName="W1", targetCompleteDate=date, version=version)
    stored = spark.createDataFrame([(1, 1, "W1", "2024-01-05", 5)], "workOrderHeaderId long, companyId int, workOrderName string, d string, version int").withColumn("targetCompleteDate", F.col("d").cast("date")).drop("d")
    of = cells.successor(spark, root, "first")
    cells.put_table(stored, root, "workOrderHeader", of, cells.hash_cell("workOrderHeaderId"))
    cells.commit(spark, root, of)
    lines = spark.createDataFrame([(1, 100)], "workOrderHeaderId long, soHeaderId long")
    for name, rows, want in (("a.json", [row("2024-01-03", 3)], ("2024-01-05", 5)), ("b.json", [row("2024-01-09", 7), row("2024-01-06", 6)], ("2024-01-09", 7)), ("c.json", [row("2024-01-06", 6)], ("2024-01-09", 7))):
        put(tmp_path / "in", name, rows)
        images = spark.readStream.schema(HEAD).json(str(tmp_path / "in"))
        feeds.image_stream(images, root, "workOrderHeader", "workOrderHeaderId", "version", feeds.target_date_compare(lines), out, ck).awaitTermination()
        after = cells.read_table(spark, root, "workOrderHeader").first()
        assert (str(after.targetCompleteDate), after.version) == want
    assert {r.payload for r in spark.read.parquet(out).collect() if "2024-01-0" in r.payload and "2024-01-09" not in r.payload} == set()


def test_digest_stream_equals_the_batch_digest(spark, tmp_path):
    t = StarSchemaTables(spark, "/root/testdata/sf0.001")
    flagged = t.soHeader.where(F.col("apiStatus") == "_NEW_")
    flagged.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(flagged.schema).parquet(str(tmp_path / "in"))
    feeds.digest_stream(stream, lambda batch: new_sales_orders(t.replace(soHeader=batch)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    advanced = spark.read.parquet(str(tmp_path / "out/advanced"))
    assert advanced.count() == flagged.count() and {r.apiStatus for r in advanced.collect()} == {"_ACK_"}
    got = spark.read.parquet(str(tmp_path / "out/lines")).drop("batch")
    want = new_sales_orders(t).lines
    assert got.count() == want.count() > 0
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_recipients_leave_out_the_editor(spark):
    t = StarSchemaTables(spark, "/root/testdata/sf0.001")
    notices = spark.createDataFrame([(1, "WorkOrder", 7)], "companyId int, sourceModule string, sourceRecordId long")
    everyone = {r.userId for r in notify_recipients(notices, t).collect()}
    assert everyone and all(u % 3 == 0 for u in everyone)
    editor = min(everyone)
    assert {r.userId for r in notify_recipients(notices, t, exclude_user=editor).collect()} == everyone - {editor}


def test_staged_csv_and_template(spark, tmp_path):
    src = tmp_path / "up"
    src.mkdir()
    (src / "one.csv").write_text("poName,qty\nP-1, 5\nP-2,x\n")
    (src / "two.csv").write_text("poName,qty\nP-3,7\n")
    got = sorted(tuple(r) for r in read_staged(spark, str(src), ["poName", "qty"]).collect())
    assert [(a, b.strip(), f) for a, b, f in got] == [("P-1", "5", "one.csv"), ("P-2", "x", "one.csv"), ("P-3", "7", "two.csv")]
    write_template(spark.createDataFrame([("P-9", "1")], "poName string, qty string"), str(tmp_path / "t"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "t")).collect()] == [("P-9", "1")]


def test_readers_keep_the_old_version_when_a_write_fails(spark, tmp_path):
    root = str(tmp_path / "pub")
    assert current_version(spark, root) is None
    first = publish(spark, root, {"a": spark.range(3), "b": spark.range(1)})
    broken = spark.range(2).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception):
        publish(spark, root, {"a": spark.range(9), "b": broken})
    assert current_version(spark, root) == first and read_published(spark, root, "a").count() == 3
    publish(spark, root, {"a": spark.range(5)})
    assert read_published(spark, root, "a").count() == 5
