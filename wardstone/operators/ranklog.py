"""Rank AUC and calibration from a log of counts that days are added to, exact and without sorting scores.

A day's rows become counts per group and score, under a whole number that orders as the score does. Counts of any
days add up. Ranks are found by radix: counts per group and leading 16 bits first, then 16 more bits within what these
leave open, and so on; a window never holds more than the 65,536 cells of one group and prefix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS, PASSES = 16, 4
_LOW = np.int64(0x7FFFFFFFFFFFFFFF)


@F.arrow_udf(T.LongType())
def score_key(score: pa.Array) -> pa.Array:
    """A number that orders as the score does; equal scores, zeros of either sign among them, have one."""
    bits = (np.asarray(score.to_numpy(zero_copy_only=False), float) + 0.0).view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ _LOW, bits), pa.int64(), mask=score.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.DoubleType())
def score_of(key: pa.Array) -> pa.Array:
    bits = key.fill_null(0).to_numpy()
    return pa.array(np.where(bits < 0, bits ^ _LOW, bits).view(float), pa.float64(), mask=key.is_null().to_numpy(zero_copy_only=False))


def counts(rows: DataFrame, attack: Column, score: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, key, a, b): attacks and others of every group and score; a null score has a null key."""
    by_score = rows.groupBy(*keys, F.col(score).cast("double").alias("of")).agg(F.count_if(attack).alias("a"), F.count_if(F.coalesce(~attack, F.lit(True))).alias("b"))
    return by_score.select(*keys, score_key("of").alias("key"), "a", "b")


def add_day(rows: DataFrame, path: str, day: str, attack: Column, score: str, keys: tuple[str, ...] = ()) -> None:
    """Write a day's counts into the log at path; a day that comes again replaces itself."""
    counts(rows, attack, score, keys).write.mode("overwrite").parquet(f"{path.rstrip('/')}/day={day}")


def read_log(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, key, a, b): the counts of all days added up."""
    return spark.read.parquet(path).groupBy(*keys, "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _cell(done: int) -> Column:
    """The BITS bits of key that follow the first `done` passes; the first pass has the sign."""
    shift = 64 - BITS * (done + 1)
    return F.shiftright("key", shift) if done == 0 else F.shiftright("key", shift).bitwiseAND(F.lit((1 << BITS) - 1))


def _prefix(done: int) -> Column:
    return F.shiftright("key", 64 - BITS * done) if done else F.lit(0).cast("long")


def auc(state: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, auc) as metrics.roc_auc gives it: each pass settles the pairs whose scores part in its bits."""
    keys, state, parts = list(keys), state.where("key is not null"), []
    for done in range(PASSES):
        cells = state.groupBy(*keys, _prefix(done).alias("prefix"), _cell(done).alias("cell")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        below = F.coalesce(F.sum("b").over(Window.partitionBy(*keys, "prefix").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        own = F.col("b") / 2 if done == PASSES - 1 else F.lit(0.0)  # equal scores count half
        parts.append(cells.select(*keys, (F.col("a") * (below + own)).alias("wins"), *[(F.col(c) if done == 0 else F.lit(0)).cast("long").alias(c) for c in ("a", "b")]))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    out = found.groupBy(*keys).agg(F.sum("wins").alias("wins"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return out.select(*keys, F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("wins") / (F.col("na") * F.col("nb"))).otherwise(0.0).alias("auc"))


def threshold(state: DataFrame, rate: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, boundary) as metrics.threshold_at_fpr gives it for the log's rows that are no attacks; null scores lie above all."""
    keys, state = list(keys), state.where("b > 0")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    joined = lambda a, b: (a.join(b, same(a, b)) if keys else a.crossJoin(b)).drop(*[b[k] for k in keys])  # noqa: E731  a row per group on the right
    total = (state.groupBy(*keys) if keys else state).agg(F.sum("b").alias("n"), F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("b"))), F.lit(0)).alias("unscored")).where("n is not null")
    at = total.select(*keys, F.greatest(F.lit(0), F.floor(F.lit(rate) * F.col("n")) - F.col("unscored")).alias("left"), F.lit(0).cast("long").alias("prefix"))
    for done in range(PASSES):  # from the largest score down: the cell in which the allowed number is passed
        inside = joined(state.where("key is not null").withColumn("own", _prefix(done)), at.select(*keys, "prefix", "left")).where("own = prefix")
        cells = inside.groupBy(*keys, "left", "prefix", _cell(done).alias("cell")).agg(F.sum("b").alias("b"))
        above = F.coalesce(F.sum("b").over(Window.partitionBy(*keys).orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = cells.withColumn("above", above).where((F.col("above") <= F.col("left")) & (F.col("above") + F.col("b") > F.col("left")))
        at = cells.select(*keys, (F.col("left") - F.col("above")).alias("left"), (F.shiftleft("prefix", BITS).bitwiseOR(F.col("cell")) if done else F.col("cell")).cast("long").alias("prefix"))
    found = at.select(*[F.col(k).alias(f"k_{k}") for k in keys], score_of("prefix").alias("boundary"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    return total.join(found, on, "left").select(*keys, "n", "boundary")
