"""Sources put together to target shares by Poisson replication.

A document's count is the inverse of a Poisson distribution at a number hashed from its id, no more than its source's
cap; the mean of the distribution is set for each source.  The hashed number is one of BINS values, so a source's tokens
by value are a histogram of fixed size, from which the realised tokens at any mean are known exactly: the mean is chosen
that comes nearest to the source's target.  A source at its cap has each document exactly cap times.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.llm.tokens import VOCABULARY, count_tokens
from skeinflow.session import discard, written

#: Values of the hashed number: a source's histogram has at most this many rows.
BINS = 8192
#: Turns of the hashed number that are tried for each source.
TURNS = 64
#: Sources with a target whose thresholds are sent to all workers; those of more are joined.
MOST_SENT = 100_000
SEED = 17


def canonical(source: Column) -> Column:
    """One name for the spellings of a source: no outer white space, lower case, underscores for hyphens."""
    return F.replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), F.lit("-"), F.lit("_"))


def hashed_bin(key: Column, seed: int = SEED) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(BINS)).cast("int")


def thresholds(mean: float, cap: int) -> list[int]:
    """Entry k - 1: the least bin whose documents come at least k times, at this mean of the distribution."""
    out, term, below = [], math.exp(-mean) if mean < 700 else 0.0, 0.0
    for k in range(cap):
        below += term
        out.append(BINS if mean == 0 else min(BINS, math.ceil(below * BINS - 1e-9)))
        term *= mean / (k + 1)
    return out


def fit_source(bins: np.ndarray, goal: float, cap: int) -> tuple[int, list[int]]:
    """(turn, thresholds) whose tokens come nearest to goal.

    ``bins`` has the tokens of each bin.  A turn is added to the hashed number, which stays uniform by that; turns are
    tried as the steps of one order are as large as its documents.
    """
    total = float(bins.sum())
    if goal <= 0 or total == 0 or cap < 1:
        return 0, [BINS] * cap
    if goal >= cap * total:
        return 0, [0] * cap
    best: tuple[float, int, list[int]] = (math.inf, 0, [])
    for turn in range(0, BINS, BINS // TURNS):
        tail = np.append(np.cumsum(np.roll(bins, turn)[::-1])[::-1], 0)
        low, high = 0.0, 800.0
        for _ in range(50):
            mean = (low + high) / 2
            if sum(int(tail[t]) for t in thresholds(mean, cap)) < goal:
                low = mean
            else:
                high = mean
        for mean in (low, high):
            cuts = thresholds(mean, cap)
            best = min(best, (abs(sum(int(tail[t]) for t in cuts) - goal), turn, cuts))
        if best[0] <= goal * 1e-4:
            break
    return best[1], best[2]


def goals(tokens: dict[str, int], share: dict[str, float], cap: dict[str, int], size: float | None) -> dict[str, float]:
    """Tokens wanted of each source.

    Without a size, the largest mix in which each source that has tokens gets exactly its share within its cap.  With a
    size, sources that can't reach their share of it give all their cap allows and the others share what is left, in
    proportion to their targets.
    """
    usable = [s for s in share if tokens.get(s, 0) > 0 and cap[s] > 0 and share[s] > 0]
    want = dict.fromkeys(share, 0.0)
    if not usable:
        return want
    whole = sum(share[s] for s in usable)
    if size is None:
        size = min(cap[s] * tokens[s] / (share[s] / whole) for s in usable)
    open_, left = list(usable), float(size)
    while open_:
        part = sum(share[s] for s in open_)
        full = [s for s in open_ if left * share[s] / part >= cap[s] * tokens[s] * (1 - 1e-12)]
        if not full:
            for s in open_:
                want[s] = left * share[s] / part
            break
        for s in full:
            want[s] = float(cap[s] * tokens[s])
        left -= sum(want[s] for s in full)
        open_ = [s for s in open_ if s not in full]
        if left <= 0:
            break
    return want


_FITS = "mix_source string, target_share double, max_repeats int, turn int, cuts array<int>, available_documents long, available_tokens long, documents long, tokens long"


def _fitted(group: pd.DataFrame) -> pd.DataFrame:
    """One row of _FITS from the histogram of a source, of at most BINS rows; a source without documents has a null bin."""
    one = group.iloc[0]
    cap, bins = int(one["cap"]), np.zeros((2, BINS), np.int64)
    some = group[group["mix_bin"].notna()]
    bins[:, some["mix_bin"].astype(int)] = some[["n_tokens", "n_rows"]].to_numpy(np.int64).T
    turn, cuts = fit_source(bins[0], float(one["goal"]), cap)
    taken = sum((np.roll(bins, turn, axis=1)[:, c:].sum(axis=1) for c in cuts), np.zeros(2, np.int64))
    values = [one["mix_source"], one["share"], cap, turn, cuts, bins[1].sum(), bins[0].sum(), taken[1], taken[0]]
    return pd.DataFrame({c.split()[0]: [v] for c, v in zip(_FITS.split(", "), values, strict=True)})


class Plan:
    """Thresholds and figures of each source with a target: ``fits``, one row for each.

    The histogram of tokens by source and hashed number is made in one pass over the texts.  Totals of each source come to
    the driver (three numbers a source); the fits are made from the histograms by one task a source.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, size: float | None = None, seed: int = SEED, vocabulary: str = VOCABULARY):
        spark = documents.sparkSession
        given = targets.select(canonical(F.col("source")).alias("mix_source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap"))
        given = given.where("mix_source is not null").groupBy("mix_source").agg(F.sum("share").alias("share"), F.max("cap").alias("cap"))
        wanted = written(given.select("mix_source", F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("cap", F.lit(0)), F.lit(0)).alias("cap")), "targets")
        self.seed, self.sources = seed, wanted.count()
        counted = count_tokens(self._eligible(documents, wanted.select("mix_source")).select("mix_source", "mix_bin", "text"), "text", vocabulary)
        histogram = written(counted.groupBy("mix_source", "mix_bin").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows")), "histogram")
        totals = histogram.groupBy("mix_source").agg(F.sum("n_tokens").alias("n"))
        rows = wanted.join(totals, "mix_source", "left").orderBy("mix_source").collect()
        want = goals({r["mix_source"]: r["n"] or 0 for r in rows}, {r["mix_source"]: r["share"] for r in rows}, {r["mix_source"]: r["cap"] for r in rows}, size)
        goal = spark.createDataFrame(list(want.items()), "mix_source string, goal double")
        each = wanted.join(goal, "mix_source").join(histogram, "mix_source", "left")
        self.fits = written(each.groupBy("mix_source").applyInPandas(_fitted, _FITS), "fits")
        discard(histogram)
        discard(wanted)

    def _beside(self, rows: DataFrame, of_sources: DataFrame) -> DataFrame:
        """Rows with what their source has; a table of many sources isn't sent to all workers, and then the join is one that
        splits a source with many rows."""
        return rows.join(F.broadcast(of_sources) if self.sources <= MOST_SENT else of_sources, "mix_source")

    def _eligible(self, documents: DataFrame, of_sources: DataFrame) -> DataFrame:
        rows = documents.select(F.col("doc_id"), canonical(F.col("source")).alias("mix_source"), hashed_bin(F.col("doc_id"), self.seed).alias("mix_bin"), F.col("text").cast("string").alias("text"))
        return self._beside(rows.where("mix_source is not null"), of_sources)

    def mixed(self, documents: DataFrame) -> DataFrame:
        """(doc_id, source, copy, text): each document as often as its count, in an order shuffled over all.

        The order is that of a hash, which is uniform: its range is cut into equal parts, one for each partition, so nothing
        is sampled and the texts are read once.
        """
        rows = self._eligible(documents, self.fits.select("mix_source", "turn", "cuts"))
        turned = F.pmod(F.col("mix_bin") + F.col("turn"), F.lit(BINS))
        rows = rows.withColumn("n", F.size(F.filter("cuts", lambda t: turned >= t))).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
        rows = rows.withColumn("o", F.xxhash64("doc_id", "copy", F.lit(self.seed + 1)))
        parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        part = F.least(F.floor((F.col("o") / F.lit(2.0**64) + 0.5) * parts), F.lit(parts - 1)).cast("int")
        placed = rows.select("doc_id", F.col("mix_source").alias("source"), "copy", "text", "o", part.alias("part")).repartitionById(parts, F.col("part"))
        return placed.sortWithinPartitions("o", "doc_id", "copy").select("doc_id", "source", "copy", "text")

    def report(self) -> DataFrame:
        """One row for each source with a target: what there is of it, what the mix has, and the shares."""
        total = self.fits.agg(F.sum("tokens")).scalar()
        ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
        return self.fits.select(
            F.col("mix_source").alias("source"), "target_share", "max_repeats", "available_documents", "available_tokens", "documents", "tokens",
            ratio(F.col("tokens"), F.col("available_tokens")).alias("repeats"), ratio(F.col("tokens"), total).alias("actual_share"),
        )


def mix(documents: DataFrame, targets: DataFrame, size: float | None = None, seed: int = SEED, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(the mixed documents, the report by source).

    Documents with a null source or one without a target stay out; a null or empty text has no tokens and is repeated
    with its source; repeated rows count each; other columns are not read.  Empty tables give an empty mix.  Sizes are
    tokens of ``vocabulary``.  The jobs that count and fit run when this is called.
    """
    plan = Plan(documents, targets, size, seed, vocabulary)
    return plan.mixed(documents), plan.report()
