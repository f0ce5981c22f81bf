"""A training-corpus pipeline: toxicity, near-duplicates, source mixing and packing, each stage a Spark job of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.llm import mixing, packing, simhash, tokens, toxicity
from auralake.llm.queries import MIX_SEED, MIX_TEMPERATURE, TOXIC_FROM, table
from auralake.session import shared_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the training fold of the labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("toxicity") < TOXIC_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more, the one with the smallest doc_id."""
    return simhash.one_of_each(docs, width=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the square roots of the sources' sizes, in random order."""
    targets = mixing.tempered_targets(docs, MIX_TEMPERATURE)
    return mixing.poisson_mix(docs, targets, MIX_SEED).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids, in windows of 256, 512 and 1024 ids."""
    return packing.pack(docs, tokens.tokenizer_file("byte_bpe_50k.json"), end_id=0)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_windows)]

#: Stages learn a model and tokenize, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Each stage's rows are written once and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
