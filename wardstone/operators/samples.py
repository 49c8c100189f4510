"""Corpora of labelled samples: validation, projections, overlap and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ID, MAX_TEXT = 64, 20_000  # fixed values


def error_code() -> Column:
    """The first rule that a sample (sample_id, text, label, family, kind) breaks, or null."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(F.coalesce(F.length("sample_id"), F.lit(0)) < 1, "id_empty").when(F.length("sample_id") > MAX_ID, "id_long")
        .when(F.coalesce(F.length("text"), F.lit(0)) < 1, "text_empty").when(F.length("text") > MAX_TEXT, "text_long")
        .when(~F.col("text").rlike(r"(?U)\S"), "text_blank").when(~F.coalesce(F.col("label").isin("attack", "benign"), F.lit(False)), "label_unknown")
        .when((F.col("label") == "attack") & empty("family"), "attack_without_family").when((F.col("label") == "attack") & ~empty("kind"), "attack_with_kind")
        .when((F.col("label") == "benign") & ~empty("family"), "benign_with_family").when((F.col("label") == "benign") & empty("kind"), "benign_without_kind")
    )


def duplicate_ids(samples: DataFrame) -> DataFrame:
    return samples.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1")


def counts(samples: DataFrame) -> DataFrame:
    """(name, n): samples per family, or kind where there is no family."""
    return samples.groupBy(F.coalesce(F.nullif("family", F.lit("")), F.col("kind")).alias("name")).agg(F.count("*").alias("n"))


def texts(samples: DataFrame) -> DataFrame:
    """(ordinal, text) of all samples."""
    return samples.select("ordinal", "text")


def labels(samples: DataFrame) -> DataFrame:
    """(ordinal, attack): 1 for attacks, 0 for harmless samples."""
    return samples.select("ordinal", (F.col("label") == "attack").cast("int").alias("attack"))


def families(samples: DataFrame) -> DataFrame:
    """(ordinal, family) of the attacks."""
    return samples.where("label = 'attack'").select("ordinal", "family")


def kinds(samples: DataFrame) -> DataFrame:
    """(ordinal, kind) of the harmless samples."""
    return samples.where("label = 'benign'").select("ordinal", "kind")


def only(samples: DataFrame, families: tuple[str, ...] = (), kinds: tuple[str, ...] = ()) -> DataFrame:
    """The attacks of the named families and the harmless samples of the named kinds."""
    return samples.where((F.col("label") == "attack") & F.col("family").isin(*families) | (F.col("label") == "benign") & F.col("kind").isin(*kinds))


def shared_texts(evaluation: DataFrame, training: DataFrame, keep: bool = True) -> DataFrame:
    """Evaluation rows whose text is among the training texts; with keep=False the others."""
    return evaluation.join(training.select("text").where("text is not null").distinct(), "text", "left_semi" if keep else "left_anti")


def line_digests(samples: DataFrame, fields: tuple[str, ...] = ("family", "kind", "label", "sample_id", "text")) -> DataFrame:
    """(ordinal, digest) of every sample's sorted-key JSON line; a fold over the order gives the corpus digest."""
    return samples.select("ordinal", F.sha2(F.to_json(F.struct(*sorted(fields))), 256).alias("digest"))
