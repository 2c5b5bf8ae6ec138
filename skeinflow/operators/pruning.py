"""Semi-joins that drop rows before they move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits of the filter: 2 MB when all are used, whatever the number of keys.
WORDS = 1 << 17


def pruned_semi(rows: DataFrame, keys: DataFrame, key: str, words: int = WORDS) -> DataFrame:
    """The rows whose ``key`` is among those of ``keys``; nulls match nothing.

    A bit for each hashed key, in at most ``words`` words, is broadcast and drops most other rows where they are read; the
    exact join follows.  With more keys than bits the filter lets more rows pass, and the result stays the same.
    """
    wanted = keys.select(key).where(F.col(key).isNotNull())

    def place(name: str):
        return F.pmod(F.xxhash64(F.col(name).cast(rows.schema[key].dataType)), F.lit(words * 64))

    one = wanted.select(place(key).alias("p")).select(F.floor(F.col("p") / 64).alias("_w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
    bits = one.groupBy("_w").agg(F.bit_or("b").alias("_b"))
    near = rows.where(F.col(key).isNotNull()).withColumn("_p", place(key)).withColumn("_w", F.floor(F.col("_p") / 64))
    near = near.join(F.broadcast(bits), "_w").where(F.getbit("_b", (F.col("_p") % 64).cast("int")) == 1).drop("_w", "_p", "_b")
    # an inner join with distinct keys, as a semi-join would be moved below the filter
    return near.join(wanted.distinct(), key).select(*rows.columns)
