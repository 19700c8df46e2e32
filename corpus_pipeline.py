"""From raw documents to token shards: toxic texts go, near copies merge, benchmark leaks go, sources are mixed, tokens are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormframe.llm import decontam, mixing, ngram_join, shards, toxicity
from stormframe.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of documents that are there."""
    marked = toxicity.marked(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return marked.where("_toxic = 0").select(*docs.columns)


#: Near copies of the pipeline: words of a shingle, and Jaccard similarity in hundredths.
SHINGLE, SIMILAR = 5, 80


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    Rows without an id have none to be smallest and stay; rows that share the kept id all stay.
    """
    groups = ngram_join.near_copies(docs, SHINGLE, SIMILAR)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no template window with the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target marginals."""
    return mixing.mix_weights(docs).where("_sampled").select(*docs.columns)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token shards that it writes."""
    return shards.materialise(docs)[0]


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("token_shards", token_shards),
]

#: The classifier, the raking and the tokenizer have no SQL form; tests compare each stage with a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over ``documents``, each reading what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
