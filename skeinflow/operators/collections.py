"""Bags of texts and of pairs with the calls of a dataflow job; every call is a lazy DataFrame operation.

Where a call takes a function, it may be a Column, a function from Column to Column (both stay in the JVM), or, behind
``python=True``, a function on plain values, which runs vectorised over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.operators.keyed import Store


def _expr(f: Column | Callable, *args: Column) -> Column:
    return f if isinstance(f, Column) else f(*args)


def _flat_python(df: DataFrame, f: Callable, schema: str, names: list[str]) -> DataFrame:
    """Rows that f gives for each row; None and empty iterables give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for out in (f(*row) or ()) if out is not None]
            if rows:
                columns = [rows] if len(names) == 1 else list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)

    return df.mapInArrow(run, schema)


#: Keys whose accumulators a task holds at once while it folds; with more, those it has are passed on and added up later.
KEYS_HELD = 200_000


def _folded(pairs: DataFrame, zero: str, f: Callable, combine: Callable | None) -> DataFrame:
    """(key, value): accumulators of the keys of each partition, several of a key where a partition has very many keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.string())], names=["key", "value"])

        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k in held:
                    held[k] = f(held[k], v)
                else:
                    held[k] = f(zero, v) if combine else v
            if len(held) > KEYS_HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    return pairs.mapInArrow(run, "key string, value string")


class Bag:
    """A bag of texts, in the column ``value``."""

    def __init__(self, df: DataFrame):
        self.df = df.select(F.col(df.columns[0]).cast("string").alias("value"))

    def flat_map(self, f, python: bool = False) -> Bag:
        """f gives an array of texts; null and empty ones give nothing."""
        if python:
            return Bag(_flat_python(self.df, f, "value string", ["value"]))
        return Bag(self.df.select(F.explode(_expr(f, F.col("value"))).alias("value")).where("value is not null"))

    def map_to_pair(self, f, python: bool = False) -> Pairs:
        """f gives one pair; null pairs are dropped."""
        if python:
            return Pairs(_flat_python(self.df, lambda v: [f(v)], "key string, value string", ["key", "value"]))
        key, value = f(F.col("value")) if callable(f) else f
        return Pairs(self.df.select(key.alias("key"), value.alias("value")).where("key is not null"))

    def flat_map_to_pair(self, f, python: bool = False) -> Pairs:
        """f gives an array of struct(key, value)."""
        if python:
            return Pairs(_flat_python(self.df, f, "key string, value string", ["key", "value"]))
        return Pairs(self.df.select(F.inline(_expr(f, F.col("value"))).alias("key", "value")))

    def filter(self, f, python: bool = False) -> Bag:
        if python:
            return Bag(_flat_python(self.df, lambda v: [v] if f(v) else [], "value string", ["value"]))
        return Bag(self.df.where(_expr(f, F.col("value"))))

    def map_partitions(self, f: Callable[[Iterator[str]], Iterable[str]]) -> Bag:
        """f maps the texts of a partition, given as an iterator, to any number of texts."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = []
            for v in f(v for part in parts for v in part["value"]):
                out.append(v)
                if len(out) == 10_000:
                    yield pd.DataFrame({"value": out})
                    out = []
            if out:
                yield pd.DataFrame({"value": out})

        return Bag(self.df.mapInPandas(run, "value string"))

    def hash_sample(self, fraction: float, seed: int = 0) -> Bag:
        """The texts whose hash is below this share of all hashes: the same ones in any layout, and all copies of a text or
        none."""
        return Bag(self.df.where(F.pmod(F.crc32(F.concat(F.lit(f"{seed}:"), F.col("value")).cast("binary")), F.lit(1_000_000)) < int(fraction * 1_000_000)))

    def sample(self, fraction: float, seed: int = 0) -> Bag:
        """Each text with this chance, by its hash and a number of its copy's own; the same for the same input layout."""
        return Bag(self.df.sample(False, fraction, seed))

    def distinct(self) -> Bag:
        return Bag(self.df.distinct())

    def intersection(self, other: Bag) -> Bag:
        """Distinct texts that are in both."""
        return Bag(self.df.intersect(other.df))

    def union(self, other: Bag) -> Bag:
        return Bag(self.df.unionAll(other.df))

    def difference(self, other: Bag) -> Bag:
        """Distinct texts that aren't in the other."""
        return Bag(self.df.subtract(other.df))

    def group_by(self, f, python: bool = False) -> Pairs:
        """(f(value), the values with this result in ascending order, joined by commas)."""
        keyed = self.map_to_pair(lambda v: (f(v), v), python=True) if python else Pairs(self.df.select(_expr(f, F.col("value")).alias("key"), "value"))
        groups = keyed.df.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("value"))
        return Pairs(groups)

    def fold(self, zero: str, f: Callable | None = None, aggregate: Column | None = None, combine: Callable | None = None) -> DataFrame:
        """One row (value): an aggregate where one says the same, else f over the partial results of the partitions.

        Without ``combine``, f must be associative: partitions are folded from their first text on, and zero is used once.
        With it, each partition is folded from zero by f (accumulator, text), and combine adds up the accumulators.  The
        order of the texts isn't defined.  An empty bag gives zero; null texts are passed to f as None.
        """
        if aggregate is not None:
            return self.df.agg(F.coalesce(aggregate.cast("string"), F.lit(zero)).alias("value"))
        # partials are made where the rows are; one row for each partition moves to one task
        partial = _folded(self.df.select(F.lit("").alias("key"), "value"), zero, f, combine).repartition(1)
        add = combine or f

        def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = zero
            for part in parts:
                for v in part["value"]:
                    acc = add(acc, v)
            yield pd.DataFrame({"value": [acc]})

        return partial.mapInPandas(finish, "value string")

    def count(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("n"))

    def take(self, n: int) -> DataFrame:
        """Any n texts, fewer where there are fewer."""
        return self.df.limit(n)

    def top(self, n: int) -> DataFrame:
        """The n least texts: a take that doesn't depend on the layout."""
        return self.df.orderBy("value").limit(n)

    def collect(self) -> list[str]:
        return [r[0] for r in self.df.collect()]

    def save_as_table(self, store: Store, name: str) -> None:
        """Rows with keys of their own, the text in the column value."""
        store.put_table(name, self.df.select(F.uuid().alias("key"), "value"))


class Pairs:
    """A bag of pairs, in the columns ``key`` and ``value``."""

    def __init__(self, df: DataFrame):
        a, b = df.columns[:2]
        self.df = df.select(F.col(a).cast("string").alias("key"), F.col(b).cast("string").alias("value"))

    def flat_map(self, f, python: bool = False) -> Bag:
        if python:
            return Bag(_flat_python(self.df, f, "value string", ["value"]))
        return Bag(self.df.select(F.explode(_expr(f, F.col("key"), F.col("value"))).alias("value")).where("value is not null"))

    def flat_map_to_pair(self, f, python: bool = False) -> Pairs:
        if python:
            return Pairs(_flat_python(self.df, f, "key string, value string", ["key", "value"]))
        return Pairs(self.df.select(F.inline(_expr(f, F.col("key"), F.col("value"))).alias("key", "value")))

    def fold_by_key(self, aggregate: Column | str, f: Callable | None = None, combine: Callable | None = None, python: bool = False) -> Pairs:
        """One pair for each key: ``fold_by_key(aggregate)`` by an algebraic aggregate, of which partial results are made
        before the shuffle, or ``fold_by_key(zero, f, python=True)`` by a function (accumulator, value), as ``Bag.fold``.

        A function's partial results are made before the shuffle too, so a key with most values sends one row for each task;
        behind it accumulators come in the order of their keys and one is held at a time.
        """
        if not python:
            return Pairs(self.df.groupBy("key").agg(aggregate.cast("string").alias("value")))
        zero, add = aggregate, combine or f

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, acc, some = None, None, False
            for batch in batches:
                keys, values = [], []
                for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if some and k == key:
                        acc = add(acc, v)
                        continue
                    if some:
                        keys.append(key)
                        values.append(acc)
                    key, acc, some = k, add(zero, v), True
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["key", "value"])
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([acc], pa.string())], names=["key", "value"])

        ordered = _folded(self.df, zero, f, combine).repartition("key").sortWithinPartitions("key")
        return Pairs(ordered.mapInArrow(finish, "key string, value string"))

    def join(self, other: Pairs) -> Pairs:
        """(key, left value + ',' + right value) for each pair of values of a key."""
        both = self.df.join(other.df.withColumnRenamed("value", "other"), "key")
        return Pairs(both.select("key", F.concat_ws(",", "value", "other").alias("value")))

    def cogroup(self, other: Pairs) -> Pairs:
        """(key, '[values],[values of the other]') for each key of either; lists ascend."""

        def lists(df: DataFrame, name: str) -> DataFrame:
            return df.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias(name))

        both = lists(self.df, "l").join(lists(other.df, "r"), "key", "full_outer")
        side = lambda c: F.concat(F.lit("["), F.coalesce(F.col(c), F.lit("")), F.lit("]"))
        return Pairs(both.select("key", F.concat(side("l"), F.lit(","), side("r")).alias("value")))

    def count_pairs(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("n"))

    def count_keys(self) -> DataFrame:
        return self.df.agg(F.count_distinct("key").alias("n"))

    def collect(self) -> list[tuple[str, str]]:
        return [tuple(r) for r in self.df.collect()]

    def save_as_table(self, store: Store, name: str) -> None:
        """One row for each key with the list of its values."""
        store.put_table(name, self.df.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("values")))


class Context:
    """What a job gets: sources, its store, its output, its parallelism."""

    def __init__(self, spark: SparkSession, store: Store | None = None):
        self.spark, self.store = spark, store or Store(spark)
        self._said: list[str] = []

    def parallelize(self, texts: list[str]) -> Bag:
        return Bag(self.spark.createDataFrame([(t,) for t in texts], "value string"))

    def from_table(self, table: DataFrame | str, f: Column | Callable, python: bool = False) -> Bag:
        """One text for each row; null ones are dropped.  With ``python``, f gets each row as a dict."""
        df = self.store.scan(table) if isinstance(table, str) else table
        if python:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    texts = [t for t in map(f, batch.to_pylist()) if t is not None]
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])

            return Bag(df.mapInArrow(run, "value string"))
        text = f if isinstance(f, Column) else f(df)
        return Bag(df.select(text.cast("string").alias("value")).where("value is not null"))

    def with_concurrency(self, bag: Bag) -> Bag:
        """The bag in as many partitions as the level says, spread evenly whatever its texts are."""
        return Bag(bag.df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions"))))

    def output(self, text: str) -> None:
        self._said.append(text)

    def said(self) -> str:
        return "".join(self._said) or "no output"

    def set_concurrency_level(self, n: int) -> None:
        """Partitions of later shuffles."""
        self.spark.conf.set("spark.sql.shuffle.partitions", str(max(1, n)))
