"""Tables of SQLite files on a mounted path, read without changing them."""

from __future__ import annotations

import sqlite3

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class SqliteTable(DataSource):
    """``spark.read.format("sqlitetable").schema(...).option("table", t).load(path)``: one table, in ranges of its row ids.

    The file is opened read-only. ``rows`` (default 100000) is the span of row ids of a partition. What
    has no row ids (views, and tables WITHOUT ROWID) is one partition.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlitetable"

    def schema(self) -> str:
        raise ValueError("give the schema of the table")

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], schema.names, int(self.options.get("rows", "100000")))


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], rows: int):
        quoted = lambda x: '"' + x.replace('"', '""') + '"'
        self.path, self.table, self.columns, self.rows = path, quoted(table), ", ".join(map(quoted, columns)), rows

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        c = self._connect()
        try:
            # A view's row ids are all null, so rows are counted by them too.
            low, high, some = c.execute(f"SELECT min(rowid), max(rowid), EXISTS (SELECT 1 FROM {self.table}) FROM {self.table}").fetchone()
        except sqlite3.OperationalError as e:
            if "rowid" not in str(e):
                raise
            return [InputPartition(None)]
        finally:
            c.close()
        if low is None:
            return [InputPartition(None)] if some else [InputPartition(0)]
        return [InputPartition(a) for a in range(low, high + 1, self.rows)]

    def read(self, partition):
        c = self._connect()
        try:
            if partition.value is None:
                yield from c.execute(f"SELECT {self.columns} FROM {self.table}")
            else:
                yield from c.execute(f"SELECT {self.columns} FROM {self.table} WHERE rowid >= ? AND rowid < ?", (partition.value, partition.value + self.rows))
        finally:
            c.close()
