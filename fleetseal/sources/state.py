"""State tables in a shared folder, changed by commits that become visible as a whole.

A table is a list of Parquet segments. A commit writes its new segments first and then a metadata file of its own that names
the segments of every table; readers follow the newest finished file, so what a failed commit left behind is never seen, and
a commit costs the same however many came before. Large tables grow by appended segments and are merged on read;
folding and compaction replace them now and then. There is one writer.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_META = "txn bigint, tables map<string,array<string>>, writers map<string,bigint>"
# Metadata of so many commits stays; a reader that began with an older one has long had its plan.
_KEPT_COMMITS = 16


@dataclass(frozen=True)
class Snapshot:
    """A commit: its number, the segments of every table, and the newest batch of every writer."""

    txn: int
    tables: dict[str, list[str]]
    writers: dict[str, int]


class StateStore:
    """Tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._meta = f"{self.root}/_meta"

    def _files(self):
        """The file system of the root, and the constructor of its paths."""
        context = self.spark.sparkContext
        make = context._jvm.org.apache.hadoop.fs.Path
        return make(self.root).getFileSystem(context._jsc.hadoopConfiguration()), make

    def _commits(self) -> list[int]:
        """Numbers of the finished commits whose metadata is there, ascending."""
        files, make = self._files()
        found = files.globStatus(make(f"{self._meta}/txn=*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().removeprefix("txn=")) for f in found)

    def snapshot(self) -> Snapshot:
        """The newest commit. Reads given the same snapshot see one state of all tables.

        Only a missing folder means that nothing was committed; metadata that cannot be read is an error.
        """
        commits = self._commits()
        if not commits:
            return Snapshot(0, {}, {})
        row = self.spark.read.schema(_META).parquet(f"{self._meta}/txn={commits[-1]:012d}").first()
        return Snapshot(row.txn, {k: list(v) for k, v in row.tables.items()}, dict(row.writers))

    def segments(self, table: str, at: Snapshot | None = None) -> list[str]:
        """Folders that make up a table."""
        return list((at or self.snapshot()).tables.get(table, []))

    def read(self, table: str, schema: str | None = None, at: Snapshot | None = None) -> DataFrame:
        """Rows of a table; an empty table needs its schema."""
        segments = self.segments(table, at)
        if not segments:
            if schema is None:
                raise LookupError(f"table {table} has no committed rows")
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{s}" for s in segments]
        reader = self.spark.read.schema(schema) if schema else self.spark.read.option("mergeSchema", "true")
        return reader.parquet(*paths)

    def has(self, table: str, at: Snapshot | None = None) -> bool:
        """Whether anything was committed to the table."""
        return bool(self.segments(table, at))

    def is_committed(self, writer: str, batch_id: int, at: Snapshot | None = None) -> bool:
        """Whether this batch of a writer, or a later one, was committed: a replay must change nothing."""
        return batch_id <= (at or self.snapshot()).writers.get(writer, -(2**63) - 1)

    def read_segments(self, segments: list[str], schema: str) -> DataFrame:
        """Rows of some segments only."""
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s}" for s in segments])

    def stage(self, table: str, rows: DataFrame, at: Snapshot | None = None) -> tuple[str, DataFrame]:
        """Write the segment the next commit will adopt, and read it back: (segment, rows).

        Nobody sees it before the commit; a retry of the same run writes it again.
        """
        segment = f"{table}/txn={(at or self.snapshot()).txn + 1}"
        rows.write.mode("overwrite").parquet(f"{self.root}/{segment}")
        return segment, self.spark.read.schema(rows.schema).parquet(f"{self.root}/{segment}")

    def commit(self, append: Mapping[str, DataFrame] | None = None, replace: Mapping[str, DataFrame] | None = None,
               keep: Mapping[str, list[str]] | None = None, adopt: Mapping[str, str] | None = None, batch_id: int = -1, writer: str = "") -> int:
        """Write segments, then promote them together.

        ``keep`` narrows a table to some of its segments, ``adopt`` adds a staged one.

        Returns the transaction number; a micro-batch that was committed before is skipped.
        """
        newest = self.snapshot()
        if writer and self.is_committed(writer, batch_id, newest):
            return -1
        tables, txn = dict(newest.tables), newest.txn + 1
        for table, segments in (keep or {}).items():
            tables[table] = list(segments)
        for table, segment in (adopt or {}).items():
            tables[table] = tables.get(table, []) + [segment]
        staged = {}
        for table, rows in {**(append or {}), **(replace or {})}.items():
            staged[table] = f"{table}/txn={txn}"
            rows.write.mode("overwrite").parquet(f"{self.root}/{staged[table]}")
        for table in append or {}:
            tables[table] = tables.get(table, []) + [staged[table]]
        for table in replace or {}:
            tables[table] = [staged[table]]
        writers = newest.writers | ({writer: batch_id} if writer else {})
        self.spark.createDataFrame([(txn, tables, writers)], _META).coalesce(1).write.mode("overwrite").parquet(f"{self._meta}/txn={txn:012d}")
        files, make = self._files()
        for old in [c for c in self._commits() if c <= txn - _KEPT_COMMITS]:
            files.delete(make(f"{self._meta}/txn={old:012d}"), True)
        return txn

    def fold(self, table: str, most: int = 32) -> int:
        """Put the segments of a table into one when there are more than ``most``; -1 if there are not.

        Rows stay as they are. The folded segments are deleted with the next fold but one, so running readers end in peace.
        """
        at = self.snapshot()
        segments = self.segments(table, at)
        if len(segments) <= most:
            return -1
        files, make = self._files()
        listed = files.listStatus(make(f"{self.root}/{table}"))
        current, before = set(segments), at.writers.get(f"fold {table}", 0)
        gone = [f.getPath() for f in listed if f"{table}/{f.getPath().getName()}" not in current and int(f.getPath().getName().removeprefix("txn=")) < before]
        schema = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{s}" for s in segments]).schema
        txn = self.commit(replace={table: self.spark.read.schema(schema).parquet(*[f"{self.root}/{s}" for s in segments])},
                          writer=f"fold {table}", batch_id=at.txn + 1)
        for path in gone:
            files.delete(path, True)
        return txn
