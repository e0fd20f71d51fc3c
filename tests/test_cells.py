"""Versions of keyed tables: bytes that follow the changes, failed and repeated writers, expiry of stream state."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cargoloom.sources import cells
from cargoloom.streaming import feeds



def cell():
    return cells.hash_cell("id", cells=50)


def start(spark, root, rows=5000):
    table = spark.range(rows).select("id", F.concat(F.lit("value "), "id").alias("v"))
    of = cells.successor(spark, root, "v0")
    cells.put_table(table, root, "t", of, cell())
    cells.commit(spark, root, of)


def written(root, version):
    return sum(p.stat().st_size for p in Path(root).glob(f"data/{version}/**/*.parquet"))


def test_a_version_writes_the_cells_it_touches(spark, tmp_path):
    root = str(tmp_path / "t")
    start(spark, root)
    changed = spark.createDataFrame([(7, "new"), (9000, "added"), (None, "no key")], "id long, v string")
    cells.change_table(spark, root, {"t": (cell(), ["id"], changed, spark.createDataFrame([(8,)], "id long"))}, "v1")
    assert 0 < written(root, "v1") < 0.15 * written(root, "v0")
    got = {r.id: r.v for r in cells.read_table(spark, root, "t").collect()}
    assert got == {**{i: f"value {i}" for i in range(5000) if i != 8}, 7: "new", 9000: "added", None: "no key"}
    # the same rows again in a version of their own: nulls and all keys are replaced, not doubled
    cells.change_table(spark, root, {"t": (cell(), ["id"], changed, None)}, "v2")
    assert cells.read_table(spark, root, "t").count() == len(got)
    assert cells.manifest(spark, root, "v0").parent is None and cells.manifest(spark, root).parent == "v1"


def test_a_failed_writer_leaves_the_old_version_and_a_repeated_one_gives_the_same(spark, tmp_path):
    root = str(tmp_path / "t")
    start(spark, root, 100)
    change = lambda v: spark.createDataFrame([(1, v)], "id long, v string")
    with pytest.raises(Exception):
        cells.change_table(spark, root, {"t": (cell(), ["id"], change("x").withColumn("v", F.raise_error(F.lit("no")).cast("string")), None)}, "v1")
    assert cells.manifest(spark, root).version == "v0" and cells.read_table(spark, root, "t").where("v = 'value 1'").count() == 1
    for _ in range(2):
        cells.change_table(spark, root, {"t": (cell(), ["id"], change("y"), None)}, "v1")
        assert cells.read_table(spark, root, "t").where("v = 'y'").count() == 1 and cells.manifest(spark, root).parent == "v0"
    cells.change_table(spark, root, {"t": (cell(), ["id"], change("z"), spark.createDataFrame([(i,) for i in range(2, 100)], "id long"))}, "v2")
    gone = cells.forget(spark, root, keep=1)
    assert any(g.startswith("v1/") for g in gone) and {r.id: r.v for r in cells.read_table(spark, root, "t").collect()} == {0: "value 0", 1: "z"}


def test_two_tables_move_together(spark, tmp_path):
    root = str(tmp_path / "t")
    of = cells.successor(spark, root, "v0")
    for name in ("a", "b"):
        cells.put_table(spark.range(10).select("id"), root, name, of, cell())
    with pytest.raises(KeyError):
        cells.read_table(spark, root, "a")
    cells.commit(spark, root, of)
    more = spark.range(10, 12).select("id")
    broken = more.select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception):
        cells.change_table(spark, root, {"a": (cell(), ["id"], more, None), "b": (cell(), ["id"], broken, None)}, "v1")
    assert [cells.read_table(spark, root, n).count() for n in ("a", "b")] == [10, 10]


def test_an_image_batch_writes_what_its_keys_touch(spark, tmp_path):
    root, src = str(tmp_path / "t"), tmp_path / "in"
    of = cells.successor(spark, root, "v0")
    cells.put_table(spark.range(20_000).select("id", F.lit(0).alias("version"), F.md5(F.col("id").cast("string")).alias("v")), root, "t", of, cells.hash_cell("id"))
    cells.commit(spark, root, of)
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps(dict(id=i, version=1, v="moved")) for i in (3, 4)))
    images = spark.readStream.schema("id long, version int, v string").json(str(src))
    compare = lambda old, new: old.join(new.select("id"), "id", "left_semi")
    feeds.image_stream(images, root, "t", "id", "version", compare, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert 0 < written(root, "batch-000000000000") < 0.06 * written(root, "v0")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert cells.read_table(spark, root, "t").where("v = 'moved'").count() == 2 and cells.read_table(spark, root, "t").count() == 20_000


ROW = "changeId long, companyId int, sourceModule string, sourceRecordId long, column string, oldValue string, newValue string, changedAt timestamp, arrivedAt timestamp"


def test_taken_keys_expire_and_late_rows_stay(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()

    def feed(batch, *rows):
        (src / f"{batch}.json").write_text("\n".join(json.dumps(dict(changeId=i, companyId=1, sourceModule="WorkOrder", sourceRecordId=i, column="qty", oldValue="1", newValue="2", changedAt=at, arrivedAt=arrived or at))
                                                     for i, at, arrived in rows))
        feeds.notice_stream(feeds.read_changes(spark, str(src), ROW), out, ck, ["changeId"], horizon_days=3, cells=4).awaitTermination()

    notices = lambda: sorted(r.sourceRecordId for r in spark.read.parquet(f"{out}/notices").collect())
    late = lambda: sorted(r.changeId for r in spark.read.parquet(f"{out}/late").collect())
    taken = lambda: sorted(r.changeId for r in cells.read_table(spark, f"{out}/state", "taken").collect())
    for day in range(1, 9):
        feed(f"d{day}", (day, f"2024-03-0{day} 08:00:00", None), (day, f"2024-03-0{day} 08:00:00", None))
        if day > 1:
            feed(f"e{day}", (day - 1, f"2024-03-0{day - 1} 08:00:00", f"2024-03-0{day} 09:00:00"))  # delivered again
    assert notices() == list(range(1, 9)) and late() == []
    assert taken() == [5, 6, 7, 8]  # bounded by the horizon
    feed("late", (20, "2024-03-06 07:00:00", "2024-03-08 10:00:00"), (21, "2024-03-01 07:00:00", "2024-03-08 10:00:00"))
    feed("again", (20, "2024-03-06 07:00:00", "2024-03-08 11:00:00"), (22, None, "2024-03-08 11:00:00"))
    feed("none", (22, None, "2024-03-08 11:30:00"))
    assert late() == [20, 21, 22, 22] and 20 in taken()
    assert notices() == list(range(1, 9))
    # little more is kept than the cells in use
    assert len(list(Path(f"{out}/state/manifests").glob("[!.]*"))) <= 2
