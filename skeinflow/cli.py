"""Tables of a folder from the command line.

    python -m skeinflow.cli FOLDER get TABLE KEY [COLUMN]
    python -m skeinflow.cli FOLDER put TABLE KEY COLUMN VALUE
    python -m skeinflow.cli FOLDER scan TABLE [START [END]]
    python -m skeinflow.cli FOLDER persist TABLE
    python -m skeinflow.cli FOLDER rename OLD NEW
    python -m skeinflow.cli FOLDER delete TABLE
    python -m skeinflow.cli FOLDER count TABLE
    python -m skeinflow.cli FOLDER tables

A table is a folder of Parquet files in long form (key, col, value, seq); put appends a write, reads see the last one.
persist replaces the log of writes by the cells that hold, and marks the table, which ``tables`` shows with a ``*``.  The
folder may be in any file system that Spark's Hadoop client knows.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession

from skeinflow.operators import keyed as K

SCHEMA = "key string, col string, value string, seq long"
#: The file that marks a persistent table; Parquet readers skip names that begin with an underscore.
MARK = "_persistent"


class _Files:
    """Folders of a file system by Hadoop's client."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *names: str) -> str:
        return "/".join([self.root, *names])

    def exists(self, *names: str) -> bool:
        return self._fs.exists(self._path(self.at(*names)))

    def folders(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory())

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self._path(self.at(old)), self._path(self.at(new)))

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(self.at(name)), True)

    def mark(self, name: str) -> None:
        self._fs.create(self._path(self.at(name, MARK)), True).close()


def _read(spark: SparkSession, files: _Files, name: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(files.at(name)) if files.exists(name) else spark.createDataFrame([], SCHEMA)


def run(spark: SparkSession, folder: str, command: str, *args: str) -> list[str]:
    """Lines that the command prints."""
    files = _Files(spark, folder)
    if args and not all(a.isidentifier() for a in args[: 2 if command == "rename" else 1]):
        raise ValueError("a table's name is letters, digits and underscores")
    if command == "tables":
        return [name + ("*" if files.exists(name, MARK) else "") for name in files.folders()]
    table = args[0]
    if command == "put":
        key, col, value = args[1:4]
        spark.createDataFrame([(key, col, value, time.time_ns())], SCHEMA).write.mode("append").parquet(files.at(table))
        return ["OK"]
    if command in ("get", "scan"):
        rows = _read(spark, files, table)
        if command == "get":
            rows = K.get_row(rows, args[1])
            rows = rows.where(rows["col"] == args[2]) if len(args) > 2 else rows
        else:
            rows = K.scan(rows, *args[1:3])
        return [f"{r['key']}\t{r['col']}\t{r['value']}" for r in K.last_writes(rows).orderBy("key", "col").toLocalIterator()]
    if command == "count":
        return [str(K.count_keys(_read(spark, files, table)).first()[0])]
    if command not in ("persist", "rename", "delete"):
        raise ValueError(f"no such command: {command}")
    if not files.exists(table):
        return ["no such table"]
    if command == "persist":
        writes = _read(spark, files, table)
        last = K.last_writes(writes).selectExpr("key", "col", "value", f"{time.time_ns()}L as seq")
        whole = table + "__whole"
        last.write.mode("overwrite").parquet(files.at(whole))
        files.mark(whole)
        files.rename(table, table + "__old")  # a break here loses nothing
        files.rename(whole, table)
        files.delete(table + "__old")
        return ["OK"]
    if command == "rename":
        if files.exists(args[1]):
            return ["the name is taken"]
        files.rename(table, args[1])
        return ["OK"]
    files.delete(table)
    return ["OK"]


def main() -> None:
    if len(sys.argv) < 3:
        sys.exit(__doc__)
    from skeinflow.session import local_session

    print("\n".join(run(local_session(app="cli"), *sys.argv[1:])))


if __name__ == "__main__":
    main()
