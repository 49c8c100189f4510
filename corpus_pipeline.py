"""From raw documents to token ids: quality, lines, near-duplicates, benchmark contamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.llm import catalog, decontaminate, linededup, minhash, quality, wfst
from wardstone.llm.common import discard, shared_table
from wardstone.tables import read_table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    The classifier learns from labelled rows outside the held-out fold. Null and empty texts are scored as texts
    without words; every row is judged by itself, so repeated rows share their fate; without usable labels there is
    nothing to judge by and all rows stay; an empty table stays empty. Other columns stay, whatever their names.
    """
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; every document stays, with n_chars counted anew.

    Null texts stay null; a null source is a source of its own; exact copies of a page count once; of lines at
    the bound, only those beyond it go. Other columns stay, whatever their names.
    """
    kept = linededup.strip_boilerplate(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity of 0.8 or more) stays: that with the smallest id.

    Null, empty and blank texts link with nothing and stay, as do rows without an id; of rows that repeat an id
    and a text one stays. Other columns stay, whatever their names.
    """
    return minhash.drop_near_duplicates(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go, by the contract's rule.

    Null and wordless texts stay; repeated rows are judged each by its own text; an empty benchmark leaves all.
    """
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document's text; null and empty texts have none, and each row gives one."""
    return wfst.encode(docs, catalog.tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality", good_documents),
    ("line dedup", without_boilerplate),
    ("near-dedup", one_of_each),
    ("decontamination", uncontaminated),
    ("encoding", encoded),
]

#: The classifier's and the encoder's rows can't be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; every other stage's table is deleted once the next one is written."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            discard(last)
        last = docs
    return docs
