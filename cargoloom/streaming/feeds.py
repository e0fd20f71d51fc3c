"""Change notices and digests as Structured Streaming jobs.

Sources are append-only files of change rows or document images; each
micro-batch runs the same functions as the batch jobs.  Outputs go to a
directory per batch id and are overwritten when a batch is run again, so a
replay after a failure writes the same rows to the same place.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import change_json, line_qty_notices, notify_recipients, target_date_notices
from ..plans.digests import Digest
from ..sources.cells import CELL, commit, day_cell, drop_cells, forget, hash_cell, manifest, put_changes, put_table, read_cells, successor, touched_cells


def read_changes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Change rows as a stream, as delivered: duplicates and late rows are sorted out by ``notice_stream``."""
    return spark.readStream.schema(schema).json(path)


def split_late(batch: DataFrame, event_time: str, arrival: str, delay_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(on time, late) by how long a row took to arrive."""
    late = F.coalesce((F.unix_timestamp(arrival) - F.unix_timestamp(event_time)) > delay_seconds, F.lit(False))
    return batch.where(~late), batch.where(late)


def notice_stream(changes: DataFrame, sink: str, checkpoint: str, key: list[str], event_time: str = "changedAt", arrival: str = "arrivedAt", delay_seconds: int = 3600,
                  horizon_days: int = 30, cells: int = 16) -> StreamingQuery:
    """Change rows carrying old and new values -> notices; late rows go to a side table, none is lost.

    Rows hold companyId, sourceModule, sourceRecordId, column, oldValue and newValue; rows without a change make no notice.
    ``key`` holds the record key and its version: a row delivered again, in the same or a later batch, counts once;
    it has the same event time then.  The keys that were taken are a table of cells by event day and key; a batch reads and rewrites the cells its rows fall in, a very
    late row the one of its own day.  Days more than ``horizon_days`` before the newest event are dropped; rows from before them
    and rows without event time can't be told from rows delivered again, and go to ``late`` each time they come.
    """
    state = f"{sink}/state"
    names = [c for c in changes.columns if c in (*key, event_time)]
    cell = day_cell(event_time, *key, cells=cells)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, f"batch-{batch_id:012d}"
        batch = batch.dropDuplicates(key).persist()
        of = successor(spark, state, version)
        newest = batch.agg(F.date_format(F.max(event_time), "yyyy-MM-dd")).first()[0]
        top = max(filter(None, [newest, *(c.partition(".")[0] for c in of.tables.get("taken", {}))]), default="0001-01-01")
        floor = (date.fromisoformat(top) - timedelta(days=min(horizon_days, date.fromisoformat(top).toordinal() - 1))).isoformat() if top > "0001" else top
        before = F.coalesce(F.date_format(event_time, "yyyy-MM-dd") < F.lit(floor), F.lit(True))
        current = batch.where(~before)
        if "taken" not in of.tables:
            put_table(current.select(*names).limit(0), state, "taken", of, cell)
        near = touched_cells(current, cell)
        taken = read_cells(spark, state, "taken", of, near)
        rows = current.join(taken.select(*key), key, "left_anti").persist()
        on_time, late = split_late(rows, event_time, arrival, delay_seconds)
        moved = change_json(on_time.where(~F.col("oldValue").eqNullSafe(F.col("newValue"))))
        notices = moved.select("companyId", "sourceModule", "sourceRecordId", F.concat(F.lit("Change "), "column").alias("eventType"), "payload")
        notices.write.mode("overwrite").parquet(f"{sink}/notices/batch={batch_id}")
        late.unionByName(batch.where(before)).write.mode("overwrite").parquet(f"{sink}/late/batch={batch_id}")
        put_changes(state, "taken", of, cell, names, rows.select(*names))
        drop_cells(of, "taken", lambda c: c.partition(".")[0] < floor)
        commit(spark, state, of)
        forget(spark, state)
        rows.unpersist()
        batch.unpersist()

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def image_stream(images: DataFrame, table_root: str, table: str, key: str, version: str, compare: Callable[[DataFrame, DataFrame], DataFrame], sink: str, checkpoint: str,
                 cells: int = 64) -> StreamingQuery:
    """New row images -> notices against the table's current rows, then the table moves on.

    The table (``cells.put_table`` with ``hash_cell(key, cells=cells)``) is the keyed state: a batch reads the cells that its keys fall in, compares with them and
    rewrites them, so its work follows the batch and the stream itself holds no state.
    A batch that ran before (its version counts already) is not applied twice.  The table holds
    ``version``; an image that isn't newer than the stored row changes nothing and makes no notice.
    """
    cell = hash_cell(key, cells=cells)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, done = batch.sparkSession, f"batch-{batch_id:012d}"
        now = manifest(spark, table_root)
        if now is None or now.version == done:
            if now is None:
                raise ValueError(f"no table below {table_root}")
            return
        of = successor(spark, table_root, done)
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), F.col(version)).alias("_r")).select(key, "_r.*").persist()
        near = read_cells(spark, table_root, table, of, touched_cells(newest, cell))
        before = near.drop(CELL)
        if version not in before.columns:
            raise ValueError(f"table {table} needs the column {version}")
        stored = before.select(F.col(key).alias("_key"), F.col(version).alias("_stored"))
        newer = F.col("_stored").isNull() | (F.col(version) > F.col("_stored"))
        fresh = newest.join(stored, F.col(key) == F.col("_key"), "left").where(newer).select(*before.columns).persist()
        compare(before, fresh).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        put_changes(table_root, table, of, cell, [key], fresh)
        commit(spark, table_root, of)
        fresh.unpersist()
        newest.unpersist()

    return images.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def target_date_compare(lines: DataFrame) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda old, new: target_date_notices(old, new, lines)


def line_qty_compare(headers: DataFrame) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda old, new: line_qty_notices(old, new, headers)


def recipient_compare(compare: Callable[[DataFrame, DataFrame], DataFrame], tables, exclude_user: int | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Fan the notices of a comparison out to their recipients."""
    return lambda old, new: notify_recipients(compare(old, new), tables, exclude_user)


def digest_stream(documents: DataFrame, build: Callable[[DataFrame], Digest], sink: str, checkpoint: str) -> StreamingQuery:
    """Document images at a trigger flag -> digest lines and the documents with their advanced flag, per batch.

    ``build`` turns a batch of documents into a digest, for example by putting the batch in place of the
    document table of a digest function.  ``advanced`` is what the document table takes over (``merge_rows``),
    so that the same documents aren't due again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        digest = build(batch)
        digest.lines.write.mode("overwrite").parquet(f"{sink}/lines/batch={batch_id}")
        digest.advanced.write.mode("overwrite").parquet(f"{sink}/advanced/batch={batch_id}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
