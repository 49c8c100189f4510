"""Held-out-family evaluation: every family is judged by a model that never saw it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.functions import features as X
from wardstone.functions import normalize as N
from wardstone.functions import scoring as S
from wardstone.functions.registry import FAMILIES, disabled_for
from wardstone.functions.scoring import sigmoid
from wardstone.operators import corpus as C
from wardstone.operators import descent as D
from wardstone.operators import metrics as M
from wardstone.operators import phrases as P
from wardstone.operators import training as T
from wardstone.tables import dealt_out, discard, shared_table


HEADLINE = "decision"  # fixed value: the layer that decides where a model is loaded


class Refusal(ValueError):
    """An evaluation that would not measure what it claims to."""


def check_disjoint(evaluation: DataFrame, training: DataFrame) -> None:
    shared = evaluation.join(training.select("text").distinct(), "text", "left_semi").count()
    if shared:
        raise Refusal(f"{shared} evaluation texts are also training texts")


def check_converged(folds: DataFrame) -> None:
    bad = [r.fold for r in folds.where("not converged").select("fold").collect()]  # a row per fold
    if bad:
        raise Refusal(f"training did not converge for {', '.join(sorted(bad))}")


def check_unseen(rows: DataFrame) -> None:
    """No fold trains on the family that it holds out."""
    seen = [r.fold for r in rows.where("attack = 1 and family = fold").select("fold").distinct().collect()]  # a row per fold
    if seen:
        raise Refusal(f"folds trained on their own family: {', '.join(sorted(seen))}")


def fold_scores(rows: DataFrame, folds: DataFrame, families: Iterable[str] = FAMILIES) -> DataFrame:
    """(fold, ordinal, attack, score): benign rows under every fold's model, attacks under the model that held their family out."""
    each = rows.select("*", F.explode(F.when(F.col("attack") == 1, F.array("family")).otherwise(F.array(*map(F.lit, families)))).alias("fold"))
    known = F.broadcast(folds.select("fold", "bias", "weights"))  # a row per fold: of fixed size
    linear = F.aggregate(F.zip_with("buckets", "values", lambda b, v: F.get("weights", b) * v), F.lit(0.0), lambda a, x: a + x)
    return each.join(known, "fold").select("fold", "ordinal", "attack", sigmoid(linear + F.col("bias")).alias("score"))


def layer_scores(rows: DataFrame, folds: DataFrame, families: Iterable[str] = FAMILIES) -> DataFrame:
    """(fold, ordinal, attack, layer, score): the five layers of the rows that a fold judges.

    Benign rows are judged in every fold, attacks in the one that held their family out. A fold's rule and signal
    layers leave out what its family motivated; its model never saw the family. rows hold the hits of all rules and
    signals of their normal form, so each fold only filters them.
    """
    families = list(families)
    off = lambda layer: F.create_map(*[x for f in families for x in (F.lit(f), F.array(*map(F.lit, sorted(disabled_for(layer, f)))).cast("array<string>"))])
    each = rows.select("*", F.explode(F.when(F.col("attack") == 1, F.array("family")).otherwise(F.array(*map(F.lit, families)))).alias("fold"))
    known = F.broadcast(folds.select("fold", "bias", "weights"))  # a row per fold: of fixed size
    linear = F.aggregate(F.zip_with("buckets", "values", lambda b, v: F.get("weights", b) * v), F.lit(0.0), lambda a, x: a + x)
    left = lambda hits, name, layer: F.filter(hits, lambda h: ~F.array_contains(F.element_at(off(layer), F.col("fold")), h[name]))
    each = each.join(known, "fold").select("fold", "ordinal", "attack", S.rule_layer(left("rules", "rule_id", "rule")).alias("r"), S.signal_layer(left("signals", "name", "signal")).alias("s"), sigmoid(linear + F.col("bias")).alias("m"))
    r, s, m = F.col("r"), F.col("s"), F.col("m")
    layers = {"rules": r, "signals": s, "model": m, "combined": S.combined_layer(r, s, m), HEADLINE: S.decision_score(r, s, m)}
    return each.select("fold", "ordinal", "attack", F.inline(F.array(*[F.struct(F.lit(k).alias("layer"), v.alias("score")) for k, v in layers.items()])))


def measured_results(scores: DataFrame, budget: float) -> DataFrame:
    """Per fold and layer: bypass with its interval, realised false positives, boundary and AUC of scores (fold, ordinal, attack, layer, score).

    Even positions of the fold's benign rows set a layer's boundary, odd ones and the attacks measure it.
    """
    keys = ("fold", "layer")
    benign = M.with_position(scores.where("attack = 0"), "ordinal", keys)
    limit = M.threshold_at_fpr(benign.where("position % 2 = 0"), "score", budget, keys).select(*keys, "boundary")
    measured = benign.where("position % 2 = 1").select(*keys, "attack", "score").unionByName(scores.where("attack = 1").select(*keys, "attack", "score"))
    flagged = F.coalesce(F.col("score") > F.col("boundary"), F.lit(True))
    attack = F.col("attack") == 1
    out = measured.join(F.broadcast(limit), list(keys)).groupBy(*keys, "boundary").agg(F.count_if(attack & ~flagged).alias("missed"), F.count_if(attack).alias("attacks"), F.count_if(~attack & flagged).alias("false_positives"), F.count_if(~attack).alias("benign"))  # a row per fold and layer
    out = out.join(M.roc_auc(measured, attack, "score", keys), list(keys)).withColumn("i", M.wilson(F.col("missed"), F.col("attacks")))
    return out.select(*keys, "missed", "attacks", F.col("i.point").alias("bypass"), F.col("i.low").alias("low"), F.col("i.high").alias("high"), "false_positives", "benign", "boundary", "auc")


def pooled_by_layer(results: DataFrame) -> DataFrame:
    """(layer, missed, attacks, bypass, low, high, control, false_positive_rate): held-out folds pooled, beside the control's bypass."""
    held = F.col("fold") != "none"
    out = results.groupBy("layer").agg(
        F.sum(F.when(held, F.col("missed"))).alias("missed"), F.sum(F.when(held, F.col("attacks"))).alias("attacks"), F.max(F.when(~held, F.col("bypass"))).alias("control"),
        (F.sum(F.when(held, F.col("false_positives"))) / F.sum(F.when(held, F.col("benign")))).alias("false_positive_rate"),
    )
    return out.withColumn("i", M.wilson(F.col("missed"), F.col("attacks"))).select("layer", "missed", "attacks", F.col("i.point").alias("bypass"), F.col("i.low").alias("low"), F.col("i.high").alias("high"), "control", "false_positive_rate")


def feature_rows(samples: DataFrame, disabled: Iterable[str] = ()) -> DataFrame:
    """(ordinal, attack, family, buckets, values, rules, signals) of samples (ordinal, text, label, family) normalised without some stages."""
    norm = N.with_normalized(samples, disabled=disabled, exact=True)
    rows = norm.select("ordinal", (F.col("label") == "attack").cast("int").alias("attack"), "family", X.exact_features(X.tokens(F.col("norm"))).alias("f"), S.rule_hits(F.col("norm")).alias("rules"), S.signal_hits(F.col("text"), F.col("norm")).alias("signals"))
    return rows.select("ordinal", "attack", "family", "f.buckets", "f.values", "rules", "signals")


def fitted_folds(training: DataFrame, families: list[str], steps: int = T.STEPS) -> Iterator[tuple[frozenset, list[str], list[str], DataFrame]]:
    """(disabled stages, families held out, folds, models) per distinct set of disabled stages; refused unless converged.

    The folds are the families held out and, where no stage is disabled, the control 'none'. A fold is fitted in one task:
    up to MAX_ROWS rows by their cells, more by their phrases. Sets beyond P.MAX_SIZE are fitted over blocks, all folds at
    once. The steps are the same.
    """
    sets: dict[frozenset, list[str]] = {}
    for family in families:
        sets.setdefault(disabled_for("stage", family), []).append(family)
    order = sorted(sets.items(), key=lambda x: sorted(x[0]))
    few = training.limit(T.MAX_ROWS + 1).count() <= T.MAX_ROWS
    by_phrases = {} if few else _phrase_folds(training, order, steps)
    for disabled, held in order:
        own = [*held, "none"] if not disabled else held
        if disabled in by_phrases:
            fitted = by_phrases[disabled]
            check_converged(fitted)
            yield disabled, held, own, fitted
            continue
        rows = feature_rows(training, disabled).select("ordinal", "attack", "family", "buckets", "values")
        if few:
            each = rows.select("*", F.explode(F.array(*map(F.lit, own))).alias("fold")).where("family <> fold")
            check_unseen(each)
            fitted = T.fit_folds(each.repartition("fold"), X.BUCKETS, steps)
        else:
            rows = shared_table(rows, "features")
            fitted = D.fit_folds(rows, own, X.BUCKETS, steps)
            discard(rows)
        fitted = training.sparkSession.createDataFrame(fitted.collect(), fitted.schema)  # a model per fold
        check_converged(fitted)
        yield disabled, held, own, fitted


def _phrase_folds(training: DataFrame, sets: list[tuple[frozenset, list[str]]], steps: int) -> dict[frozenset, DataFrame]:
    """Models by disabled stages, fitted by phrases in one job; none for sets that are too large. Equal texts are normalised once."""
    families = [f for _, held in sets for f in held]
    number = F.create_map(*[x for i, f in enumerate(families) for x in (F.lit(f), F.lit(i))])
    texts = training.groupBy("text", "label", "family").agg(F.count("*").alias("n"))
    texts = shared_table(texts.select("text", (F.col("label") == "attack").cast("int").alias("attack"), F.coalesce(F.element_at(number, F.coalesce("family", F.lit(""))), F.lit(-1)).alias("own"), "n"), "texts")
    found, made = {}, [texts]
    for disabled, held in sets:
        norm = N.with_normalized(dealt_out(texts, "text"), disabled=disabled, exact=True)
        blocks = shared_table(P.coded(norm.select(F.array_join(X.tokens(F.col("norm")), " ").alias("text"), "attack", "own", "n")), "phrases")
        made.append(blocks)
        if P.size_of(blocks) <= P.MAX_SIZE:
            found[disabled] = (blocks, [(f, families.index(f)) for f in held] + [("none", -2)] * (not disabled))
    if found:
        models = P.fit_folds(list(found.values()), X.BUCKETS, steps)
        rows = models.collect()  # a model per fold
        own = {k: {name for name, _ in folds} for k, (_, folds) in found.items()}
        found = {k: training.sparkSession.createDataFrame([r for r in rows if r.fold in names], models.schema) for k, names in own.items()}
    discard(*made)
    return found


def evaluate(training: DataFrame, evaluation: DataFrame, budget: float = 0.01, families: Iterable[str] = FAMILIES, drop_shared: bool = False, steps: int = T.STEPS) -> DataFrame:
    """measured_results of every family and layer, plus the control fold 'none' that holds nothing out.

    A fold's normalisation leaves out the stages its family motivated; folds that leave out the same stages share
    their features. The control measures every n-th attack, n being the number of families. Refused: texts on
    both sides (unless drop_shared), families without samples, training that does not converge.
    """
    families = list(families)
    if drop_shared:
        evaluation = evaluation.join(training.select("text").distinct(), "text", "left_anti")
    else:
        check_disjoint(evaluation, training)
    for side, name in ((training, "training"), (evaluation, "evaluation")):
        there = {r.family for r in side.where("label = 'attack'").select("family").distinct().collect()}
        if set(families) - there:
            raise Refusal(f"no {name} samples of {', '.join(sorted(set(families) - there))}")
    scores = None
    for disabled, held, own, fitted in fitted_folds(training, families, steps):
        measured = feature_rows(evaluation, disabled)
        found = layer_scores(measured.where((F.col("attack") == 0) | F.col("family").isin(held)), fitted, own)
        if "none" in own:
            every = M.with_position(evaluation.where("label = 'attack'"), "ordinal").where(F.col("position") % len(families) == 0)
            found = found.unionByName(layer_scores(feature_rows(every, disabled).withColumn("family", F.lit("none")), fitted, own))
        found = shared_table(found, "scores")  # the measures read scores many times; plans of whole normalisations in each take minutes to analyse
        scores = found if scores is None else scores.unionByName(found)
    return measured_results(scores, budget)


PROBED = ("homoglyph", "hypothetical", "indirect")


def lexicon_probe(spark: SparkSession, per_family: int = 120, benign_total: int = 1800, held_out: int = 60, seeds: tuple[int, int] = (31, 47), budget: float = 0.01, families: Iterable[str] = PROBED) -> DataFrame:
    """(arm, family, attacks, bypass, low, high, false_positives, benign) of two arms: 'shared', where training and
    evaluation draw from one lexicon, and 'disjoint', where each has its own half of it.

    A bypass that rises from the first arm to the second is owed to words that the model knew, not to the technique.
    """
    out = None
    for arm, halves in (("shared", (None, None)), ("disjoint", (0, 1))):
        training = shared_table(C.generate(spark, seeds[0], per_family, benign_total, half=halves[0]), "training")
        evaluation = shared_table(C.generate(spark, seeds[1], held_out, benign_total, exclude=training, half=halves[1]), "evaluation")
        found = evaluate(training, evaluation, budget, families).where((F.col("layer") == HEADLINE) & (F.col("fold") != "none"))
        found = found.select(F.lit(arm).alias("arm"), F.col("fold").alias("family"), "attacks", "bypass", "low", "high", "false_positives", "benign")
        out = found if out is None else out.unionByName(found)
    return out
