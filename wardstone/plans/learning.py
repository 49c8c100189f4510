"""Queries over features, linear scores, the message grammar and held-out-family folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.functions import features as X
from wardstone.operators import corpus as C
from wardstone.operators import evaluate as E
from wardstone.operators import training as T
from wardstone.tables import dealt_out, read_table, shared_table

#: A closed form in place of trained weights, so that SQL can score too
WEIGHT = "((bucket * 37) % 101 - 50) / 1000.0D"


def _docs(spark, sf_dir):
    return dealt_out(read_table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")), "doc_id")


def closed_form_weights(spark: SparkSession) -> DataFrame:
    return spark.range(X.BUCKETS).select(F.col("id").cast("int").alias("bucket")).withColumn("weight", F.expr(WEIGHT))


def tokens(spark, sf_dir):
    words = X.tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", words.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("digest"))


def word_ngrams(spark, sf_dir):
    """How often each word pair occurs per language."""
    rows = _docs(spark, sf_dir).select("lang", X.tokens(F.col("text")).alias("w")).select("lang", F.explode(X.word_grams(F.col("w"), 2)).alias("gram"))
    return rows.groupBy("lang", "gram").agg(F.count("*").alias("n"))


def char_ngrams(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("lang", X.tokens(F.col("text")).alias("w")).select("lang", F.explode(X.char_grams(F.col("w"))).alias("gram"))
    return rows.groupBy("lang", "gram").agg(F.count("*").alias("n"))


def hashed_features(spark, sf_dir):
    counts = X.hashed(_docs(spark, sf_dir), "text", "doc_id")
    return counts.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("count").alias("total"), F.max("count").alias("largest"))


def l2_rows(spark, sf_dir):
    rows = X.unit_rows(_docs(spark, sf_dir), "text", "doc_id")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.max(F.abs("value")), 9).alias("largest"), F.round(F.sum(F.abs("value")), 6).alias("l1"))


def linear_score(spark, sf_dir):
    score = X.scorer(closed_form_weights(spark), 0.25)
    return _docs(spark, sf_dir).select("doc_id", F.round(score(F.col("text")), 9).alias("score"))


def top_features(spark, sf_dir):
    """The five buckets that move a text most, taken where its features are made."""
    top = X.strongest(closed_form_weights(spark), 5)
    rows = X.text_batches(_docs(spark, sf_dir)).select("doc_id", top(F.col("text")).alias("t")).select("doc_id", F.posexplode_outer("t").alias("at", "t"))
    rows = rows.where("at IS NOT NULL")  # an inner one infers a filter on its array, by which the features are made twice
    return rows.select("doc_id", (F.col("at") + 1).cast("long").alias("rank"), F.col("t.bucket").cast("long").alias("bucket"), F.round("t.contribution", 9).alias("contribution"))


def blake2b_features(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", X.exact_features(X.tokens(F.col("text"))).alias("f"))
    norm = F.sqrt(F.aggregate("f.values", F.lit(0.0), lambda a, v: a + v * v))
    return rows.select("doc_id", F.size("f.buckets").cast("long").alias("n"), F.round(norm, 9).alias("norm"))


def grammar_corpus(spark, sf_dir):
    """One attack per document, drawn by its id, families in turn."""
    return C.attacks(_docs(spark, sf_dir).select(F.col("doc_id").alias("draw")), seed=5).select(F.col("draw").alias("doc_id"), "family", "text")


def grammar_dedup(spark, sf_dir):
    """Distinct attacks per family and the draws that repeated an earlier one."""
    drawn = C.attacks(_docs(spark, sf_dir).select(F.col("doc_id").alias("draw")), seed=5)
    return C.first_draws(drawn).groupBy("family").agg(F.count_if("fresh").alias("kept"), F.count_if(~F.col("fresh")).alias("collisions"))


def benign_quota(spark, sf_dir):
    """Each language's document count shared out over the benign kinds by largest remainders."""
    total = _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("total"))
    return C.quotas(spark, total, "lang")


def train_weights(spark, sf_dir):
    """The models of lofo_folds: one per held-out family and the control's, which holds out none."""
    found = [fitted for *_, fitted in E.fitted_folds(_training(spark, sf_dir), list(C.FAMILIES), T.STEPS)]
    return reduce(lambda a, b: a.unionByName(b), found).select("fold", F.round("loss", 9).alias("loss"), "converged", "iterations", F.round("bias", 9).alias("bias"))


def _samples(spark, sf_dir, side):
    """Messages grown from the documents' ids; the two sides share no text, however many documents there are."""
    rows = C.mixed(_docs(spark, sf_dir).select(F.col("doc_id").alias("draw")), 7, side)
    return rows.select("ordinal", "text", F.when(F.col("attack") == 1, "attack").otherwise("benign").alias("label"), "family")


def _training(spark, sf_dir):
    return shared_table(_samples(spark, sf_dir, 0), "training")


def lofo_folds(spark, sf_dir):
    """Bypass of every held-out family at a 1 % budget of false positives, by the model that never saw it; the control is fold 'none'.

    Trained on one half of the grammar's texts, a message for every document, and measured on the other half.
    """
    return E.evaluate(_training(spark, sf_dir), shared_table(_samples(spark, sf_dir, 1), "evaluation"), 0.01, C.FAMILIES, drop_shared=True, steps=T.STEPS)


def queries() -> dict:
    found = (tokens, word_ngrams, char_ngrams, hashed_features, l2_rows, linear_score, top_features, blake2b_features, grammar_corpus, grammar_dedup, benign_quota, train_weights, lofo_folds)
    return {f.__name__: f for f in found}


_TOKENS = "t AS MATERIALIZED (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+|\\p{Nd}+|[^\\s\\p{L}\\p{N}_]') AS w FROM documents)"
_PAIRS = "list_transform(range(1, len(w)), lambda i: 'w2:' || w[i] || ' ' || w[i + 1])"
_CHARS = "list_transform(range(1, length(p) - 2), lambda i: 'c:' || substring(p, i, 4))"


def keys_sql(messages: str) -> str:
    """f(doc_id, bucket, n): hashed counts of messages (doc_id, text), as common table expressions."""
    return f"tk AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+|\\p{{Nd}}+|[^\\s\\p{{L}}\\p{{N}}_]') AS w FROM ({messages})), k AS (SELECT doc_id, unnest(list_concat(list_concat(list_transform(w, lambda x: 'w1:' || x), {_PAIRS}), {_CHARS})) AS key FROM (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS p FROM tk)), f AS (SELECT doc_id, CAST('0x' || substr(md5(key), 13, 4) AS INT) % {X.BUCKETS} AS bucket, sum(CASE WHEN md5(key) >= '8' THEN 1.0::DOUBLE ELSE -1.0 END) AS n FROM k GROUP BY 1, 2)"


_KEYS = keys_sql("SELECT doc_id, text FROM documents")
CLOSED_FORM_SQL = _W = "((CAST((bucket * 37) % 101 AS DOUBLE) - 50) / 1000)"


def oracle_sql() -> dict[str, str]:
    return {
        "tokens": f"WITH {_TOKENS} SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM t",
        "word_ngrams": f"WITH {_TOKENS} SELECT lang, gram, count(*) AS n FROM (SELECT lang, unnest({_PAIRS}) AS gram FROM t) GROUP BY ALL",
        "char_ngrams": f"WITH {_TOKENS} SELECT lang, gram, count(*) AS n FROM (SELECT lang, unnest({_CHARS}) AS gram FROM (SELECT lang, ' ' || array_to_string(w, ' ') || ' ' AS p FROM t)) GROUP BY ALL",
        "hashed_features": f"WITH {_KEYS} SELECT bucket, count(*) AS rows, sum(n) AS total, max(n) AS largest FROM f GROUP BY bucket",
        "l2_rows": f"WITH {_KEYS}, u AS (SELECT doc_id, n / CASE WHEN sqrt(sum(n * n) OVER (PARTITION BY doc_id)) > 0 THEN sqrt(sum(n * n) OVER (PARTITION BY doc_id)) ELSE 1 END AS value FROM f) SELECT doc_id, count(*) AS n, round(max(abs(value)), 9) AS largest, round(sum(abs(value)), 6) AS l1 FROM u GROUP BY doc_id",
        "linear_score": f"WITH {_KEYS} , z AS (SELECT doc_id, sum(n * {_W}) / CASE WHEN sqrt(sum(n * n)) > 0 THEN sqrt(sum(n * n)) ELSE 1 END AS z FROM f GROUP BY doc_id) SELECT doc_id, round(coalesce(z, 0) + 0.25, 9) AS score FROM documents LEFT JOIN z USING (doc_id)",
        "top_features": f"WITH {_KEYS}, c AS (SELECT doc_id, CAST(bucket AS BIGINT) AS bucket, n * {_W} AS contribution FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(contribution) DESC, bucket) AS rank FROM c) SELECT doc_id, rank, bucket, round(contribution, 9) AS contribution FROM r WHERE rank <= 5",
        "grammar_corpus": C.attacks_sql(5) + " SELECT doc_id, family, text FROM a",
        "grammar_dedup": C.attacks_sql(5) + ", r AS (SELECT family, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS fresh FROM a) SELECT family, count(*) FILTER (fresh) AS kept, count(*) FILTER (NOT fresh) AS collisions FROM r GROUP BY family",
        "benign_quota": C.quotas_sql("SELECT lang, count(*) AS total FROM documents GROUP BY lang", "lang"),
    }
