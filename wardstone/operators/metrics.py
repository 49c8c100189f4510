"""Intervals, confusion, grouped rates, rank AUC, calibration and positions as DataFrame operations.

Ranks and positions never sort a whole table in one task: rows fall into ranges between quantiles of their key, so
that ranges stay even however the values pile up; a small table of range totals gives each range its offset, and
windows run inside ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstone.tables import shared_table

Z = 1.959963984540054  # fixed value: the two-sided 95 % normal quantile
STEPS = 16  # ranges are found in two steps of as many
KEYS_SENT = 1_000  # groups whose range bounds, 2 KB each, are sent to all tasks; those of more lie in a shared table


def wilson(hits: Column, total: Column) -> Column:
    """struct(point, low, high, total): the Wilson interval of a share; (0, 0, 1) for no rows; hits beyond total fail."""
    k, n = hits.cast("double"), total.cast("double")
    p, z2 = k / n, Z * Z
    middle, spread = p + z2 / (2 * n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low = F.when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (middle - spread) / (1 + z2 / n)))
    high = F.when(k == n, 1.0).otherwise(F.least(F.lit(1.0), (middle + spread) / (1 + z2 / n)))
    some = n > 0
    wrong = some & ((k < 0) | (k > n))
    point = F.when(wrong, F.raise_error(F.lit("hits must lie between 0 and total")).cast("double")).when(some, p).otherwise(0.0)
    return F.struct(point.alias("point"), F.when(some, low).otherwise(0.0).alias("low"), F.when(some, high).otherwise(1.0).alias("high"), total.cast("long").alias("total"))


def confusion(attack: Column, score: Column, threshold: float) -> list[Column]:
    """Aggregates tp, fn, fp, tn; a score at the threshold is flagged."""
    flagged = score >= threshold
    return [F.count_if(attack & flagged).alias("tp"), F.count_if(attack & ~flagged).alias("fn"), F.count_if(~attack & flagged).alias("fp"), F.count_if(~attack & ~flagged).alias("tn")]


def rates(df: DataFrame) -> DataFrame:
    """recall, bypass, false_positive_rate and precision beside tp, fn, fp, tn."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fn, fp, tn = map(F.col, ("tp", "fn", "fp", "tn"))
    return df.withColumns({"recall": share(tp, tp + fn), "bypass": share(fn, tp + fn), "false_positive_rate": share(fp, fp + tn), "precision": share(tp, tp + fp)})


def rate_by_group(df: DataFrame, group: str, hit: Column) -> DataFrame:
    """(group, hits, total, point, low, high): Wilson intervals of the share of hits per group."""
    out = df.groupBy(group).agg(F.count_if(hit).alias("hits"), F.count("*").alias("total"))
    return out.withColumn("i", wilson(F.col("hits"), F.col("total"))).select(group, "hits", "total", "i.point", "i.low", "i.high")


def _bounds(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(keys, coarse, fine): values of by that cut each key's rows into STEPS * STEPS ranges of about equal size.

    They are taken once, so that every use of them cuts alike. coarse holds each STEPS-th value, fine the values
    between, as one array per coarse range.
    """
    shares = [i / (STEPS * STEPS) for i in range(1, STEPS * STEPS)]
    cut = F.percentile_approx(by, shares, 10_000).alias("cut")
    rows = (df.groupBy(*keys) if keys else df).agg(cut).where("cut is not null")
    few = rows.limit(KEYS_SENT + 1).collect()
    if len(few) > KEYS_SENT:  # any number of keys: a table, joined by a shuffle
        rows = shared_table(rows, "bounds")
        coarse = F.transform(F.sequence(F.lit(STEPS - 1), F.lit(STEPS * STEPS - 2), F.lit(STEPS)), lambda i: F.get("cut", i))
        fine = F.transform(F.sequence(F.lit(1), F.lit(STEPS * (STEPS - 1) + 1), F.lit(STEPS)), lambda i: F.slice("cut", i, F.lit(STEPS - 1)))
        return rows.select(*keys, coarse.alias("coarse"), fine.alias("fine"))
    found = [(*[r[k] for k in keys], r["cut"][STEPS - 1 :: STEPS], [r["cut"][i : i + STEPS - 1] for i in range(0, STEPS * STEPS, STEPS)]) for r in few]
    kind = df.schema[by].dataType.simpleString()
    own = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return F.broadcast(df.sparkSession.createDataFrame(found, f"{own}{', ' * bool(keys)}coarse array<{kind}>, fine array<array<{kind}>>"))


def _running(df: DataFrame, keys: list[str], by: str, counts: list[str]) -> DataFrame:
    """df (one row per key and value of by) with before_<c>: the sum of c over smaller values of by within the keys.

    A null value of by has no place: its row is left out.
    """
    df = df.where(F.col(by).isNotNull())
    bounds = _bounds(df, keys, by)
    same = [df[k].eqNullSafe(bounds[k]) for k in keys]
    df = df.join(bounds, same).drop(*[bounds[k] for k in keys]) if keys else df.crossJoin(bounds)  # one row of bounds
    high = F.size(F.filter("coarse", lambda x: x < F.col(by)))
    df = df.withColumn("high", high).withColumn("range", F.col("high") * STEPS + F.size(F.filter(F.get("fine", F.col("high")), lambda x: x < F.col(by)))).drop("coarse", "fine", "high")
    total = df.groupBy(*keys, "range").agg(*[F.sum(c).alias(f"r_{c}") for c in counts])  # at most STEPS * STEPS rows per group
    earlier = Window.partitionBy(*[F.col(k) for k in keys], F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("range").alias("r_range"), *[F.coalesce(F.sum(f"r_{c}").over(earlier), F.lit(0)).alias(f"o_{c}") for c in counts])
    within = Window.partitionBy(*keys, "range").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    on = F.col("range") == F.col("r_range")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    names = [c for c in df.columns if c != "range"]
    return df.join(total, on).select(*names, *[(F.col(f"o_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"before_{c}") for c in counts])


def roc_auc(df: DataFrame, attack: Column, score: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, auc): chance that an attack outscores a benign row, ties half; 0 where either side is empty."""
    keys = list(keys)
    by_score = df.groupBy(*keys, score).agg(F.count_if(attack).alias("a"), F.count_if(~attack).alias("b"))
    run = _running(by_score, keys, score, ["a", "b"])
    out = run.groupBy(*keys).agg(F.sum(F.col("a") * (F.col("before_b") + F.col("b") / 2)).alias("wins"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return out.select(*keys, F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("wins") / (F.col("na") * F.col("nb"))).otherwise(0.0).alias("auc"))


def threshold_at_fpr(benign: DataFrame, score: str, rate: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, boundary): the score that at most rate of benign rows lie strictly above; null where all may be flagged.

    A row is flagged when its score is above the boundary, so ties never exceed the budget.
    """
    keys = list(keys)
    by_score = benign.groupBy(*keys, score).agg(F.count("*").alias("n"))
    total = by_score.groupBy(*keys).agg(F.sum("n").alias("total"))
    run = _running(by_score, keys, score, ["n"])
    run = run.join(F.broadcast(total), keys) if keys else run.crossJoin(F.broadcast(total))
    allowed = F.floor(F.lit(rate) * F.col("total"))
    # the (allowed + 1)-th largest score: the largest with more than `allowed` rows at it or above
    at = F.max(F.when(F.col("total") - F.col("before_n") > allowed, F.col(score)))
    return run.groupBy(*keys, F.col("total")).agg(at.alias("boundary")).withColumnRenamed("total", "n")


def with_position(df: DataFrame, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with position: 0-based place of each row in the order of a numeric, unique column."""
    return _running(df.withColumn("one", F.lit(1).cast("long")), list(keys), order, ["one"]).withColumnRenamed("before_one", "position").drop("one")


def quantiles_at(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """(name, value): the value at index min(n - 1, floor(share * (n - 1) + 0.5)) of the sorted values; 0 for no rows."""
    by_value = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    run = _running(by_value, [], value, ["n"])
    total = by_value.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    want = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("share")) for k, v in shares.items()]))
    want = total.select("total", want.alias("w")).select("w.name", F.least(F.col("total") - 1, F.floor(F.col("w.share") * (F.col("total") - 1) + 0.5)).alias("at"))
    found = F.broadcast(want).join(run, (F.col("at") >= F.col("before_n")) & (F.col("at") < F.col("before_n") + F.col("n")), "left")
    return found.select("name", F.coalesce(F.col(value), F.lit(0.0)).alias("value"))


def gate(folds: DataFrame, recorded: DataFrame, tolerance: float = 0.05, ceiling: float = 0.03) -> DataFrame:
    """(family, verdict, change): each family's bypass against the recorded one, and its false positives against the ceiling.

    unknown: not recorded; unmeasured: recorded but absent; regressed: beyond tolerance; too_many_false_positives;
    improved: lower than recorded; ok.
    """
    both = folds.select("family", "bypass", "false_positive_rate").join(recorded.select("family", F.col("bypass").alias("was")), "family", "full_outer")
    verdict = (
        F.when(F.col("was").isNull(), "unknown").when(F.col("bypass").isNull(), "unmeasured").when(F.col("bypass") > F.col("was") + tolerance, "regressed")
        .when(F.col("false_positive_rate") > ceiling, "too_many_false_positives").when(F.col("bypass") < F.col("was"), "improved").otherwise("ok")
    )
    return both.select("family", verdict.alias("verdict"), (F.col("bypass") - F.col("was")).alias("change"))


def run_failures(budget: float, pooled: float, control: float | None, recorded: dict, tolerance: float = 0.05) -> list[str]:
    """What of a whole run fails against a recorded baseline: another budget, a pooled rate or a control beyond tolerance."""
    if abs(budget - recorded["target_false_positive_rate"]) > 1e-9:
        return [f"the budget is {budget} and the baseline's is {recorded['target_false_positive_rate']}: the rates cannot be compared"]
    out = []
    if pooled > recorded["pooled_bypass"] + tolerance:
        out.append(f"the pooled bypass rose from {recorded['pooled_bypass']:.4f} to {pooled:.4f}")
    if control is not None and control > recorded["control_bypass"] + tolerance:
        out.append(f"the control's bypass rose from {recorded['control_bypass']:.4f} to {control:.4f}")
    return out
