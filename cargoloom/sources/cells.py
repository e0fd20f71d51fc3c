"""Keyed tables kept as cells of files, with versions that rewrite only the cells they touch.

A table's rows are dealt to cells by a text that follows from the row (``cell_of``: the key's hash, or a day and the key's hash).
A version is a manifest, a small file that says for each table and cell in which version's folder its rows are; one pointer names
the manifest that counts.  To change rows, the cells of their keys are read, put right and written below the new version, and the
new manifest takes all other cells over.  Readers see the old version until the pointer moves, so a writer that
fails or is repeated leaves it readable; one writer at a time.  A manifest has an entry per table and cell, whatever the rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The column that the rows are dealt by; a folder name, not part of the table.
CELL = "_cell"


def hash_cell(*key: str, cells: int = 64) -> Column:
    """One of ``cells`` cells by the key; null is a key too.  Choose ``cells`` so that one holds some 100 MB."""
    return F.lpad(F.pmod(F.xxhash64(*[F.col(c) for c in key]), F.lit(cells)).cast("string"), 6, "0")


def day_cell(moment: str, *key: str, cells: int = 16) -> Column:
    """A cell of the row's day, so that days can be dropped; rows without time share a day."""
    return F.concat(F.coalesce(F.date_format(moment, "yyyy-MM-dd"), F.lit("0000-00-00")), F.lit("."), hash_cell(*key, cells=cells))


@dataclass
class Manifest:
    """Which folder holds each cell of each table: ``tables`` are {name: {cell: version}}."""

    version: str
    parent: str | None = None
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)


class _Files:
    """Small files below a root, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root, self.conf, self.gateway = spark._jvm, root, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """The file with a new content, by one rename."""
        fresh = self.path(f"{name}.new")
        stream = self.fs.create(fresh, True)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(fresh, self.path(name), how)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def manifest(spark: SparkSession, root: str, version: str | None = None) -> Manifest | None:
    """The manifest that counts, or that of a version; None where there is none."""
    files = _Files(spark, root)
    version = version or files.read("POINTER")
    text = files.read(f"manifests/{version}") if version else None
    return Manifest(**json.loads(text)) if text else None


def _write(rows: DataFrame, root: str, name: str, version: str) -> list[str]:
    """Write rows that carry their cell; the cells that have rows."""
    spark, folder = rows.sparkSession, f"data/{version}/{name}"
    rows.repartition(CELL).write.partitionBy(CELL).mode("overwrite").parquet(f"{root}/{folder}")
    return [n.partition("=")[2] for n in _Files(spark, root).names(folder) if n.startswith(f"{CELL}=")]


def read_cells(spark: SparkSession, root: str, name: str, of: Manifest, cells: Iterable[str] | None = None) -> DataFrame:
    """A table of a version, or some of its cells, with the cell of each row."""
    have = of.tables[name]
    wanted = have if cells is None else {c: have[c] for c in cells if c in have}
    schema = StructType.fromJson(json.loads(of.schemas[name]))
    parts = [f"{root}/data/{version}/{name}/{CELL}={cell}" for cell, version in sorted(wanted.items())]
    if not parts:
        return spark.createDataFrame([], schema.add(CELL, "string"))
    return spark.read.schema(schema).parquet(*parts).withColumn(CELL, F.element_at(F.regexp_extract_all(F.col("_metadata.file_path"), F.lit(f"{CELL}=([^/]*)")), -1))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version that counts."""
    of = manifest(spark, root)
    if of is None or name not in of.tables:
        raise KeyError(f"no table {name} below {root}")
    return read_cells(spark, root, name, of).drop(CELL)


def commit(spark: SparkSession, root: str, of: Manifest) -> None:
    """Make a version the one that counts."""
    files = _Files(spark, root)
    files.replace(f"manifests/{of.version}", json.dumps(of.__dict__))
    files.replace("POINTER", of.version)


def successor(spark: SparkSession, root: str, version: str) -> Manifest:
    """The manifest that a writer of ``version`` starts from.  A version that counts already is made again from the one before it."""
    now = manifest(spark, root)
    if now is not None and now.version == version:
        now = manifest(spark, root, now.parent) if now.parent else None
    if now is None:
        return Manifest(version)
    return Manifest(version, now.version, {n: dict(c) for n, c in now.tables.items()}, dict(now.schemas))


def put_table(rows: DataFrame, root: str, name: str, of: Manifest, cell: Column) -> None:
    """Write a whole table below a version that isn't committed yet."""
    of.schemas[name] = json.dumps(rows.schema.jsonValue())
    of.tables[name] = {c: of.version for c in _write(rows.withColumn(CELL, cell), root, name, of.version)}


def touched_cells(rows: DataFrame, cell: Column) -> list[str]:
    """The cells that rows fall in: at most as many as a table has."""
    return sorted(r[0] for r in rows.select(cell).distinct().collect())


def put_changes(root: str, name: str, of: Manifest, cell: Column, key: Sequence[str], changed: DataFrame, deleted: DataFrame | None = None, old: DataFrame | None = None) -> list[str]:
    """Put changed rows in place of those with their key, and leave deleted keys out; the cells that were rewritten.

    Only cells that a changed or deleted key falls in are read and written.  Changed rows have the table's columns and one row per key.
    ``old``, the present rows of those cells (with their cell), saves reading them a second time.
    """
    spark, key = changed.sparkSession, list(key)
    gone = changed.select(*key) if deleted is None else changed.select(*key).unionByName(deleted.select(*key))
    cells = touched_cells(gone, cell)
    if not cells:
        return []
    stay = old if old is not None else read_cells(spark, root, name, of, cells)
    keys = gone.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)])
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    columns = [c for c in stay.columns if c != CELL]
    rows = stay.join(keys, same, "left_anti").unionByName(changed.select(*columns).withColumn(CELL, cell))
    written = _write(rows, root, name, of.version)
    for c in cells:
        of.tables[name].pop(c, None)
    of.tables[name].update({c: of.version for c in written})
    return cells


def drop_cells(of: Manifest, name: str, past: Callable[[str], bool]) -> None:
    """Leave cells out of a version, by their name."""
    of.tables[name] = {c: v for c, v in of.tables.get(name, {}).items() if not past(c)}


def change_table(spark: SparkSession, root: str, changes: Mapping[str, tuple[Column, Sequence[str], DataFrame, DataFrame | None]], version: str) -> str:
    """A version in which several tables change together: {name: (cell, key, changed, deleted)}."""
    of = successor(spark, root, version)
    for name, (cell, key, changed, deleted) in changes.items():
        put_changes(root, name, of, cell, key, changed, deleted)
    commit(spark, root, of)
    return version


def forget(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the files that none of the last ``keep`` versions has; the folders that went."""
    files, at, used, kept = _Files(spark, root), manifest(spark, root), set(), set()
    while at is not None and len(kept) < max(1, keep):
        kept.add(at.version)
        used |= {f"{v}/{n}/{CELL}={c}" for n, cells in at.tables.items() for c, v in cells.items()}
        at = manifest(spark, root, at.parent) if at.parent else None
    gone = []
    for version in files.names("data"):
        for name in files.names(f"data/{version}"):
            for cell in files.names(f"data/{version}/{name}"):
                if cell.startswith(CELL) and f"{version}/{name}/{cell}" not in used:
                    files.delete(f"data/{version}/{name}/{cell}")
                    gone.append(f"{version}/{name}/{cell}")
    for version in files.names("manifests"):
        if version not in kept:
            files.delete(f"manifests/{version}")
    return gone
