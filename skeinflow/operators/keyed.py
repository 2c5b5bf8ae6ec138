"""Keyed tables: rows with a key and a set of columns that may differ by row, in long form (key, col, value, seq).

A write is a row; the value of a cell is its last write.  Reads are filters that Parquet can prune by, upserts are one
aggregation, and a store keeps its tables as views or as Parquet files in a folder.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAGE_ROWS = 10


def scan(table: DataFrame, start: object = None, end: object = None, key: str = "key") -> DataFrame:
    """Rows with start <= key < end; an open end where either is None."""
    if start is not None:
        table = table.where(F.col(key) >= F.lit(start))
    if end is not None:
        table = table.where(F.col(key) < F.lit(end))
    return table


def get_row(table: DataFrame, row: object, key: str = "key") -> DataFrame:
    """The rows of one key; none where there is no such key."""
    return table.where(F.col(key) == F.lit(row))


def get_cell(table: DataFrame, row: object, column: str, key: str = "key") -> DataFrame:
    return get_row(table, row, key).select(key, column)


def existing(keys: DataFrame, table: DataFrame, key: str = "key") -> DataFrame:
    """Those of ``keys`` that the table has."""
    return keys.join(table.select(key), key, "left_semi")


def last_writes(writes: DataFrame, cell: list[str] | None = None, value: str = "value", order: str = "seq") -> DataFrame:
    """Each cell's last write; of equally late ones the greatest value.  Combines on the map side."""
    cell = cell or ["key", "col"]
    last = F.max(F.struct(F.col(order), F.col(value))).alias("_last")
    return writes.groupBy(*cell).agg(last).select(*cell, F.col(f"_last.{value}").alias(value))


def put_rows(table: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """The table with whole rows replaced by those of the same key."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def count_keys(table: DataFrame, key: str = "key") -> DataFrame:
    return table.agg(F.count_distinct(F.col(key)).alias("n"))


def wide(writes: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each key with the last write of each named column; null where there was none."""
    last = last_writes(writes)
    picks = [F.max(F.when(F.col("col") == c, F.col("value"))).alias(c) for c in columns]
    return last.groupBy("key").agg(*picks)


def viewed_page(table: DataFrame, page: int, key: str = "key", rows: int = PAGE_ROWS) -> DataFrame:
    """Page ``page`` (from 0) of the table in the order of its keys: a top-k of the pages so far, not a sort of all.

    Missing cells are empty texts, as all values are shown as text.
    """
    shown = _paged(table, page, key, rows)
    return shown.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in table.columns])


def _paged(table: DataFrame, page: int, key: str, rows: int) -> DataFrame:
    upto = table.orderBy(key).limit((page + 1) * rows)
    numbered = upto.withColumn("_n", F.row_number().over(Window.orderBy(key)))
    return numbered.where(F.col("_n") > page * rows).drop("_n")


def viewed_cells(writes: DataFrame, page: int, rows: int = PAGE_ROWS) -> DataFrame:
    """Page ``page`` of a table in long form (key, col, value, seq): its columns are the union of those of the page's rows,
    in order; a missing cell is an empty text."""
    keys = _paged(writes.select("key").distinct(), page, "key", rows)
    cells = last_writes(writes.join(keys, "key", "left_semi"))
    columns = sorted(r[0] for r in cells.select("col").distinct().collect())  # of one page of rows
    picks = [F.max(F.when(F.col("col") == c, F.coalesce(F.col("value").cast("string"), F.lit("")))) for c in columns]
    wide_rows = cells.groupBy("key").agg(F.lit(None).alias("_"), *[F.coalesce(p, F.lit("")).alias(c) for p, c in zip(picks, columns, strict=True)]).drop("_")
    return wide_rows.withColumn("key", F.col("key").cast("string"))


def recovered(log: DataFrame, key: str = "key", place: str = "pos") -> DataFrame:
    """The rows of an append-only log that hold: of each key the one at the last place."""
    rest = [c for c in log.columns if c not in (key, place)]
    last = F.max_by(F.struct(*rest), F.col(place)).alias("r")
    return log.groupBy(key).agg(last).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


class Store:
    """Named tables of a session: views, or Parquet files where they were persisted."""

    def __init__(self, spark: SparkSession, folder: str | None = None, prefix: str = "kv_"):
        self.spark, self.folder, self.prefix = spark, folder.rstrip("/") if folder else None, prefix
        self._kept: set[str] = set()  # tables that were persisted

    def _name(self, name: str) -> str:
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"not a table name: {name!r}")
        return self.prefix + name

    def put_table(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(self._name(name))

    def scan(self, name: str, start: object = None, end: object = None, key: str = "key") -> DataFrame | None:
        """Rows of a range; None where there is no such table."""
        return scan(self.spark.table(self._name(name)), start, end, key) if self.has(name) else None

    def has(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self._name(name))

    def tables(self) -> list[str]:
        return sorted(t.name[len(self.prefix) :] for t in self.spark.catalog.listTables() if t.name.startswith(self.prefix))

    def described(self, key: str = "key") -> DataFrame:
        """(name, n_keys, persistent) of all tables."""
        each = [
            count_keys(self.spark.table(self._name(t)), key).select(F.lit(t).alias("name"), F.col("n").alias("n_keys"), F.lit(t in self._kept).alias("persistent"))
            for t in self.tables()
        ]
        if not each:
            return self.spark.createDataFrame([], "name string, n_keys long, persistent boolean")
        out = each[0]
        for e in each[1:]:
            out = out.unionByName(e)
        return out

    def rename(self, old: str, new: str) -> bool:
        """Whether it was done: not without the old table, nor onto one that is there."""
        if not self.has(old) or self.has(new):
            return False
        self.put_table(new, self.spark.table(self._name(old)))
        if old in self._kept:
            self._kept.add(new)
        self.delete(old)
        return True

    def delete(self, name: str) -> bool:
        self._kept.discard(name)
        return self.spark.catalog.dropTempView(self._name(name))

    def copy(self, source: str, target: str, key: str = "key") -> None:
        """Puts all rows of one table into another."""
        rows = self.spark.table(self._name(source))
        self.put_table(target, put_rows(self.spark.table(self._name(target)), rows, key) if self.has(target) else rows)

    def persist(self, name: str) -> bool:
        """Writes a table to the folder and reads it from there; False where it was persistent before."""
        if self.folder is None:
            raise ValueError("the store has no folder")
        path = f"{self.folder}/{name}"
        try:
            self.spark.table(self._name(name)).write.mode("error").parquet(path)
        except Exception as e:
            if "already exists" in str(e).lower() or "PATH_ALREADY_EXISTS" in str(e):
                return False
            raise
        self.put_table(name, self.spark.read.parquet(path))
        self._kept.add(name)
        return True


#: Patterns that are compared as they are; more are looked up by a part of theirs.
MOST_LISTED = 1000


def matching(rows: DataFrame, value: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """The rows whose ``value`` is LIKE one of the patterns; null values and patterns match nothing.

    Up to MOST_LISTED patterns become one condition.  Of more, each is known by the rarest run of four plain characters that
    it holds: rows are joined on the runs of their value, and what meets is compared exactly.  Patterns without such a run are
    few by nature (they hold no four plain characters in a row) and become conditions.  A row comes out once.
    """
    kept = patterns.select(F.col(pattern).alias("_p")).where("_p is not null").distinct()
    listed = kept.limit(MOST_LISTED + 1).collect()
    if len(listed) <= MOST_LISTED:
        return rows.where(_like_any(F.col(value), [r[0] for r in listed]))
    from skeinflow.session import written

    # of the runs of a pattern the one that the fewest patterns have, so that what all hold (a protocol, a domain) meets none
    runs_of = kept.select("_p", F.explode_outer(F.array_distinct(F.regexp_extract_all("_p", F.lit(r"(?=([^%_\\]{4}))"), F.lit(1)))).alias("_r"))
    least = runs_of.join(runs_of.groupBy("_r").agg(F.count(F.lit(1)).alias("_n")), "_r", "left")
    known = written(least.groupBy("_p").agg(F.min(F.struct(F.col("_n"), F.col("_r"))).alias("_l")).select("_p", F.coalesce("_l._r", F.lit("")).alias("_r")), "patterns")
    bare = [r[0] for r in known.where("_r = ''").select("_p").toLocalIterator()]
    marked = rows.withColumn("_id", F.monotonically_increasing_id()).where(F.col(value).isNotNull())
    marked = written(marked, "valued")  # the numbers of the rows must not change
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - 3, F.lit(1))), lambda i: F.substring(F.col(value), i, F.lit(4))))
    near = marked.select("_id", F.col(value).alias("_v"), F.explode(runs).alias("_r")).join(known.where("_r <> ''"), "_r")
    hit = near.where(F.expr("_v like _p")).select("_id").distinct()
    both = hit.unionByName(marked.where(_like_any(F.col(value), bare)).select("_id")).distinct()
    return marked.join(both, "_id", "left_semi").drop("_id")


def _like_any(value: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for text in sorted(patterns):
        out = out | value.like(text)
    return F.coalesce(out, F.lit(False))
