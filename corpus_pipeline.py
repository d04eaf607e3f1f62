"""A corpus from raw documents to packed sequences: five stages, each reading what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from snapweave.llm.common import staged
from snapweave.llm.queries import held_out

#: Documents with this score or a higher one are rejected.
MOST_TOXIC = 0.3


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under MOST_TOXIC; the classifier learns from the labelled ones among ``docs``.

    Null and empty texts have the base rate's score and stay where that is under MOST_TOXIC; rows that repeat are judged each.
    """
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return docs.where(toxicity.score_of(model, "text") < F.lit(MOST_TOXIC))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id; null texts are empty ones. Of rows that repeat an id and a text one stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the smallest id. Rows without words or id stay."""
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is one of its own, texts without words are taken by no epoch."""
    return mixing.sample_mix(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, with the documents, starts and lengths of their pieces; a document that the mix repeats is packed as often."""
    return packing.sequences(packing.pack(docs, with_ids=True))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

#: A trained classifier decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
