"""From raw documents to training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontam, langid, mixing, ngram_join, sharding
from siltstone.llm.common import Tables, fresh, ship

#: Below this share of the probability a language is a guess between two.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: documents of no determined language. The others keep their columns."""
    ship(spark)
    model = langid.fit_ppm(langid.training_texts(docs.filter(~langid.held_out(F.col("doc_id")))))
    lang, score, rate = fresh(docs.columns, "lang_pred", "score", "bits_per_byte")
    told = langid.identify(docs, model, tuple(docs.columns), out=(lang, score, rate))
    return told.filter((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stays: the smallest id of each class of linked documents."""
    ship(spark)
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: documents that overlap with a benchmark item."""
    ship(spark)
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stays: a draw by calibrated probabilities."""
    ship(spark)
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: No SQL for context trees or clusters; tests/llm hold run() against brute force, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of the documents that all stages kept."""
    with Tables(spark) as tables:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for _, stage in STAGES[:-1]:
            docs = tables.table(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)
