"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.llm import covertree, decontaminate, hardneg, language, lexical, license, linededup, minhash, oracles, quality, secrets, tokenfiles, toxicity, wfst
from wardstone.llm.common import shared_path
from wardstone.tables import read_table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
p AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, i, n, item_id FROM p JOIN bw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_boilerplate(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("text_md5"))


OP4_SQL = r"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS page, i, line, nullif(trim(line, ' ' || chr(9) || chr(13)), '') AS bare
           FROM (SELECT doc_id, source, text, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line
                 FROM (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
n AS (SELECT coalesce(source, '') AS host, count(DISTINCT coalesce(text, '')) AS pages FROM documents GROUP BY 1),
bad AS (SELECT host, bare FROM (SELECT DISTINCT host, page, bare FROM l WHERE bare IS NOT NULL) JOIN n USING (host) GROUP BY host, bare, pages HAVING count(*) > 1 AND count(*) > 0.04::DOUBLE * pages),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(bad.bare) AS n_dropped, string_agg(CASE WHEN bad.bare IS NULL THEN line END, chr(10) ORDER BY i) AS text
      FROM l LEFT JOIN bad ON l.host = bad.host AND l.bare = bad.bare GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE n_lines END AS n_lines, CASE WHEN d.text IS NULL THEN 0 ELSE n_dropped END AS n_dropped,
       CASE WHEN d.text IS NOT NULL THEN length(coalesce(k.text, '')) END AS n_chars_kept, CASE WHEN d.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS text_md5
FROM documents d JOIN k USING (doc_id)
"""


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file, the same on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.encode(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path, folder = tokenizer_path("word_bpe_49k.json"), shared_path(spark, "tokens")
    shards, buckets = tokenfiles.write_tokens(docs, folder, path, end_id=1)
    width = tokenfiles.Encoder(path, 1).width
    return tokenfiles.read_tokens(tokenfiles.document_keys(docs), folder, shards, buckets, width).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(read_table(spark, sf_dir, "documents")).drop("copies")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    found = (op1_benchmark_decontamination, op2_embedding_near_dedup, op3_secret_scan, op4_line_dedup, op5_sentencepiece, op6_token_files, op7_minhash_near_dedup, op8_quality_classifier, op9_license_scan, op10_language_id, op11_hard_negatives, op12_toxicity, op13_lexical_search)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_benchmark_decontamination": OP1_SQL, "op2_embedding_near_dedup": oracles.OP2, "op3_secret_scan": oracles.OP3, "op4_line_dedup": OP4_SQL, "op7_minhash_near_dedup": oracles.OP7, "op9_license_scan": oracles.OP9, "op11_hard_negatives": oracles.OP11, "op13_lexical_search": oracles.OP13}
