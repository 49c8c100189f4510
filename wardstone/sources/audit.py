"""The audit log: append-only JSON lines of verdicts without their texts, and its readers."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from secrets import token_hex

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardstone.functions import normalize as N
from wardstone.functions import scoring as S
from wardstone.functions.registry import disabled_for
from wardstone.tables import shared_table

SCHEMA = "at timestamp, fingerprint string, length int, score double, decision string, called boolean, layers struct<rules:double,signals:double,model:double,combined:double,decision:double>, reasons array<string>, text string"


@dataclass(frozen=True)
class Policy:
    """How messages are judged and what is written of them; enforcing needs a log."""

    flag: float = S.FLAG
    block: float = S.BLOCK
    enforce: bool = False
    log: str | None = None
    keep_text: bool = False
    salt: str = ""
    max_log_bytes: int = 64 * 1024 * 1024  # fixed value: a log of this size takes no more records
    rotate: bool = False  # of a stream's log: its oldest batches make room instead

    def __post_init__(self):
        if not 0 <= self.flag <= self.block <= 1:
            raise ValueError("thresholds need 0 <= flag <= block <= 1")
        if self.enforce and self.log is None:
            raise ValueError("a policy that blocks must record what it blocked")
        if not self.salt:
            object.__setattr__(self, "salt", token_hex(16))


def inspect(messages: DataFrame, policy: Policy | None = None, text: str = "text", model_score: str | None = None, family: str | None = None) -> DataFrame:
    """messages with norm, score, decision, layers and reasons.

    model_score names a column with the learned layer's probability; it alone decides where given. Texts are
    normalised in exact Unicode, as the learned layer's are. family: the fold that holds this family out, without the
    stages, rules and signals that it motivated.
    """
    policy = policy or Policy()
    off = {layer: disabled_for(layer, family) for layer in ("stage", "rule", "signal")}
    df = N.with_normalized(messages, text, off["stage"], exact=True).withColumn("__r", S.rule_hits(F.col("norm"), off["rule"])).withColumn("__s", S.signal_hits(F.col(text), F.col("norm"), off["signal"]))
    df = df.withColumn("__rl", S.rule_layer(F.col("__r"))).withColumn("__sl", S.signal_layer(F.col("__s")))
    model = F.col(model_score) if model_score else F.lit(0.0)
    df = df.withColumn("score", S.decision_score(F.col("__rl"), F.col("__sl"), model if model_score else None))
    layers = F.struct(F.col("__rl").alias("rules"), F.col("__sl").alias("signals"), model.alias("model"), S.combined_layer(F.col("__rl"), F.col("__sl"), model).alias("combined"), F.col("score").alias("decision"))
    df = df.withColumn("decision", S.decide(F.col("score"), policy.enforce, policy.flag, policy.block)).withColumn("layers", layers)
    return df.withColumn("reasons", S.reasons(F.col("__r"), F.col("__s"))).drop("__r", "__s", "__rl", "__sl")


def records(verdicts: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """Log rows of verdicts: figures to six places; the text only where the policy keeps it."""
    six = F.transform(F.array(*[F.col(f"layers.{n}") for n in ("rules", "signals", "model", "combined", "decision")]), lambda x: F.round(x, 6))
    names = ("rules", "signals", "model", "combined", "decision")
    layers = F.struct(*[F.get(six, F.lit(i)).alias(n) for i, n in enumerate(names)])
    kept = [F.col(text).alias("text")] if policy.keep_text else []
    return verdicts.select(F.current_timestamp().alias("at"), S.fingerprint(F.col(text), policy.salt).alias("fingerprint"), F.length(text).alias("length"), F.round("score", 6).alias("score"), "decision", (F.col("decision") != "block").alias("called"), layers.alias("layers"), "reasons", *kept)


def log_bytes(spark: SparkSession, path: str) -> int:
    """Size of a log folder, 0 where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(folder).getLength() if files.exists(folder) else 0


def append(found: DataFrame, policy: Policy) -> bool:
    """Append records to the policy's log; whether they were written. A full log or a failing disk never fails the messages."""
    try:
        if log_bytes(found.sparkSession, policy.log) >= policy.max_log_bytes:
            return False
        found.write.mode("append").json(policy.log)
    except (Py4JError, PySparkException, OSError) as e:
        logging.getLogger(__name__).warning("the audit log was not written: %s", e)
        return False
    return True


def guard(messages: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """Judge messages once and, where the policy has a log, append their records; the verdicts, as a shared table.

    What is logged and what is returned are the same rows, whatever the messages' plan.
    """
    verdicts = shared_table(inspect(messages, policy, text), "verdicts")
    if policy.log:
        append(records(verdicts, policy, text), policy)
    return verdicts


def run(messages: DataFrame, policy: Policy, call, text: str = "text") -> DataFrame:
    """Outcomes: call (DataFrame to DataFrame with a response column) sees every message that is not blocked."""
    verdicts = guard(messages, policy, text)
    passed = call(verdicts.where("decision <> 'block'")).withColumn("refusal", F.lit(None).cast("string"))
    refused = verdicts.where("decision = 'block'").withColumn("response", F.lit(None).cast("string")).withColumn("refusal", F.lit("blocked"))
    return passed.unionByName(refused, allowMissingColumns=True)


def wrap(call, policy: Policy):
    """A transform for DataFrame.transform: run with a fixed call."""
    return lambda messages: run(messages, policy, call)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log rows, those of a stream's batches too; lines that are no records are dropped."""
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", True).json(path, mode="DROPMALFORMED").where("decision is not null or score is not null")


def summary(log: DataFrame) -> DataFrame:
    """(decision, n) with a missing decision as unknown."""
    return log.groupBy(F.coalesce("decision", F.lit("unknown")).alias("decision")).agg(F.count("*").alias("n"))


def _batches(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of a log's batch folders, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in files.listStatus(folder) if x.isDirectory() and x.getPath().getName().startswith("batch-")] if files.exists(folder) else []
    return sorted((x.getName(), files.getContentSummary(x).getLength()) for x in found)


def append_batch(found: DataFrame, batch: int, policy: Policy, path: str) -> bool:
    """Write a stream's batch of records into its own folder of the log; whether they are there.

    A batch that comes again replaces itself. Of a log that has reached max_log_bytes the oldest batches go where the
    policy rotates; else the batch is not written. A failing disk never fails the stream.
    """
    spark, own = found.sparkSession, f"batch-{batch:012d}"
    try:
        total = log_bytes(spark, path) - dict(_batches(spark, path)).get(own, 0)
        for name, size in _batches(spark, path) if policy.rotate else ():
            if total >= policy.max_log_bytes and name < own:
                gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
                gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
                total -= size
        if total >= policy.max_log_bytes:
            return False
        found.write.mode("overwrite").json(f"{path}/{own}")
    except (Py4JError, PySparkException, OSError) as e:
        logging.getLogger(__name__).warning("a batch of the audit log was not written: %s", e)
        return False
    return True


def guard_stream(messages: DataFrame, policy: Policy, path: str, checkpoint: str) -> StreamingQuery:
    """Judge a stream of messages and append the records to a log folder, a batch to a folder; stateless, so nothing grows.

    A batch that is replayed after a failure adds nothing, and the log keeps to max_log_bytes but for its last batch.
    """
    judged = records(inspect(messages, policy), policy)
    write = lambda rows, batch: append_batch(rows, batch, policy, path) and None
    return judged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
