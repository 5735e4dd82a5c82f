"""From raw documents to packed token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes every stage's result as
Parquet in the cluster's shared folder and hands the reread table to the next,
so a lost executor never reaches back beyond the stage that is running.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farewatch.llm import decontaminate, jaccard, mixing, packing, toxicity
from farewatch.llm.common import save
from farewatch.session import configure


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the toxicity threshold; the network is fitted on the labelled ones."""
    configure(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of linked documents."""
    configure(spark)
    return jaccard.keep_representatives(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs within its edit budget."""
    configure(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the probabilities that rake the mixture to its targets."""
    configure(spark)
    return mixing.draw_documents(docs)


def pack_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids with cumulative segment lengths and positions."""
    configure(spark)
    return packing.packed_rows(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_to_targets),
    ("token_output", pack_token_ids),
]

# The network, the edit matching and the tokenizer are not SQL; tests hold the
# stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``; returns the last stage's table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
