"""A training-data pipeline of five stages; each reads what the one before it wrote.

Further columns of documents pass through all stages but the last, whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontam, mixing, neardup, tokens, toxicity
from lodestar.llm.common import new_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score one half or more; the model is learned from labelled rows of the training fold.

    Null and empty texts score 0.02 and stay, repeated rows stay as often as they come. Without labels, or with none
    that are toxic, no insult is known and only threats are dropped. Null ids in documents or labels teach nothing.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn(toxicity.training_rows(docs, labels)))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, the one with the least id; null ids come last.

    Null and empty texts are equal to each other, so one of them stays; of repeated rows one stays.
    """
    return neardup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts and items match nothing; without items all stay."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fills the token budget from the tree of sources; a document of a second epoch comes twice.

    Null languages and sources are nodes of their own. Repeated rows are taken or left together.
    """
    domain = mixing.domain_of(F.coalesce("source", F.lit("")))
    return mixing.mix(docs, domain, mixing.WEIGHTS, percent=mixing.PERCENT, max_epochs=mixing.MAX_EPOCHS, seed=mixing.SEED, bare=True)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what is read back from them.

    Null texts are empty and have the end id alone; null ids come first; repeated rows are documents of their own.
    """
    out = new_path(spark, "tokens")
    tokens.write_tokens(docs, out, tokens.tokenizer_path())
    return tokens.read_tokens(spark, out)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token ids", tokens_stage),
]

#: A learned model, connected components and the tokenizer are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
