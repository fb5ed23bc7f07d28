"""From raw documents to token ids: quality, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Between stages the documents are written as Parquet in the shared folder and read again, so a lost executor never
takes more than a stage's running tasks with it.

Rows that every stage bears: columns beside those of ``documents`` pass through all but the last; null ids and sources
are values like others; texts of any length are read whole; repeated rows are rows of their own, unless a stage says
otherwise; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, jaccard, mixing, pii, quality
from corpusloom.llm.common import read, store
from corpusloom.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go, null and empty texts among them; repeated rows are
    judged alike. Scores at the threshold stay."""
    return quality.keep(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest doc_id. Texts without words and rows
    with a null doc_id stay; rows that repeat the kept id all stay."""
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that give it away, are generalised to their kind; all rows stay, null texts stay null."""
    return pii.sanitise(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a null source is one of its own, texts without words go, and of repeated
    rows as many are taken as the budget holds."""
    return mixing.mixed(docs, read(spark, sf_dir, "labels"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids of every row, and decoded_sha256 of the text that its ids decode to; null and empty texts have
    no ids."""
    return bpe.round_trip(docs, tokenizer("word_bpe_49k.json"), carry=("doc_id", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

#: No stage but the mix can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = store(stage(spark, docs, sf_dir), f"pipeline_{i}")
    return docs
