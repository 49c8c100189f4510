"""Corpora, messages, models and baselines on disk.

Corpora are JSON lines (plain or .gz, by suffix alone), one sample a line, in a file or a folder of part files. Reading
is strict: unknown fields, broken lines and invalid samples are named by line; the decompressed size and the length of
a line are bounded before anything is parsed, and numbers of lines hold over any number of splits.
"""

from __future__ import annotations

import gzip
import json
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.operators import merkle
from wardstone.operators.metrics import with_position
from wardstone.operators.samples import error_code
from wardstone.operators.training import Fit
from wardstone.sources.lines import MAX_BYTES, TooLarge, read_lines
from wardstone.sources.parts import PART_ROWS, write_parts

FIELDS = ("sample_id", "text", "label", "family", "kind", "meta")
SCHEMA = "sample_id string, text string, label string, family string, kind string, meta map<string,string>"


class SourceError(ValueError):
    """A file that cannot be used as it is."""


def is_compressed(path: str) -> bool:
    return path.endswith(".gz")


def read_corpus(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(ordinal, sample_id, text, label, family, kind, meta) of a corpus file; blank lines are skipped.

    Fails with the first bad line's number for broken JSON, unknown fields or an invalid sample, and for repeated
    ids, an empty corpus or one larger than max_bytes.
    """
    lines = _lines(spark, path, max_bytes)
    bad = lines.where("error is not null").orderBy("line").first()
    if bad:
        raise SourceError(f"{path}:{bad['line']}: {bad['error']}")
    rows = lines.where(F.trim("value") != "").select("line", F.from_json("value", SCHEMA).alias("s"), F.json_object_keys("value").alias("keys"), F.get_json_object("value", "$").alias("whole"))
    rows = rows.select("line", "keys", "whole", "s.*")
    broken = F.when(F.col("whole").isNull() | F.col("keys").isNull(), "not_json").when(F.size(F.array_except("keys", F.array(*map(F.lit, FIELDS)))) > 0, "unknown_field").otherwise(error_code())
    first = rows.withColumn("error", broken).where("error is not null").orderBy("line").first()
    if first:
        raise SourceError(f"{path}:{first['line']}: {first['error']}")
    again = rows.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1").first()
    if again:
        raise SourceError(f"{path}: sample id {again['sample_id']} repeats")
    out = rows.select(F.col("line").alias("ordinal"), *[F.coalesce(c, F.lit("")).alias(c) if c in ("family", "kind") else F.col(c) for c in FIELDS])
    if out.isEmpty():
        raise SourceError(f"{path}: no samples")
    return out


def _lines(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """bounded lines (line, value, error) of a path; files that cannot be used are SourceErrors."""
    try:
        return read_lines(spark, path, max_bytes)
    except (TooLarge, FileNotFoundError) as e:
        raise SourceError(str(e)) from e
    except PySparkException as e:
        raise SourceError(f"{path}: not readable: {str(e).strip().splitlines()[-1]}") from e


def corpus_lines(samples: DataFrame) -> DataFrame:
    """(ordinal, value): each sample as JSON with sorted keys."""
    fields = sorted(c for c in samples.columns if c in FIELDS)
    return samples.select("ordinal", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_corpus(samples: DataFrame, path: str) -> None:
    """One file of JSON lines in order, byte for byte the same for the same samples (gzip by suffix, no time in it)."""
    opened = gzip.GzipFile(path, "wb", mtime=0) if is_compressed(path) else open(path, "wb")
    with opened as out:
        for row in corpus_lines(samples).orderBy("ordinal").toLocalIterator():  # a partition at a time
            out.write(row["value"].encode() + b"\n")


def write_corpus_folder(samples: DataFrame, path: str, compressed: bool = False, part_rows: int = PART_ROWS) -> None:
    """The same lines as a folder of numbered part files in order, for corpora beyond one file: committed as a whole, and
    byte for byte the same for the same samples."""
    write_parts(corpus_lines(samples), path, compressed=compressed, part_rows=part_rows)


def read_messages(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(line, text): one message a line, white-space lines dropped; bounded like a corpus."""
    lines = _lines(spark, path, max_bytes)
    text = F.when(F.col("error").isNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.lit(f"{path}:"), F.col("line").cast("string"), F.lit(": "), F.col("error"))).cast("string"))
    return lines.select("line", text.alias("text")).where(F.col("text").rlike(r"(?U)\S"))


def save_model(fit: Fit, path: str) -> None:
    Path(path).write_text(fit.to_json() + "\n")


def load_model(path: str, buckets: int) -> Fit:
    if not Path(path).exists():
        raise SourceError(f"{path}: no such model")
    return Fit.from_json(Path(path).read_text(), buckets)


def save_baseline(path: str, pooled: float, control: float, families: dict[str, float], budget: float, digests: dict[str, str]) -> None:
    body = {"format": 1, "pooled_bypass": pooled, "control_bypass": control, "family_bypass": families, "target_false_positive_rate": budget, **digests}
    Path(path).write_text(json.dumps(body, sort_keys=True, indent=2) + "\n")


def load_run_baseline(path: str) -> dict:
    """A recorded baseline with all its fields."""
    try:
        body = json.loads(Path(path).read_text())
    except (OSError, ValueError) as e:
        raise SourceError(f"{path}: no baseline") from e
    if not isinstance(body, dict) or body.get("format") != 1:
        raise SourceError(f"{path}: another format")
    missing = {"family_bypass", "pooled_bypass", "control_bypass", "target_false_positive_rate"} - set(body)
    if missing:
        raise SourceError(f"{path}: without {', '.join(sorted(missing))}")
    return body


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(family, bypass) of a recorded baseline."""
    return spark.createDataFrame(sorted(load_run_baseline(path)["family_bypass"].items()), "family string, bypass double")


def corpus_digest(samples: DataFrame) -> str:
    """The root of the hash tree over the ordered JSON lines; nothing but the root reaches the driver."""
    return merkle.root(merkle.tree(corpus_lines(samples), "ordinal", F.col("value")))


def numbered(samples: DataFrame, order: str) -> DataFrame:
    """samples with a dense ordinal from 1 in the order of a column without nulls or repeats."""
    return with_position(samples, order).withColumn("ordinal", F.col("position") + 1).drop("position")
